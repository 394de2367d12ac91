"""Tables that grow: files that arrive in a folder are appended to a stored table, or pass a predicate, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.expressions import Scope, predicate
from ..plans.parser import parse_cnf
from ..sources.tables import insert


def arriving(spark: SparkSession, folder: str, schema: T.StructType, where: str = "") -> DataFrame:
    """Rows of Parquet files as they arrive, filtered."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.where(predicate(parse_cnf(where), Scope(rows))) if where else rows


def load_arriving(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Inserts what has arrived into the table at `path`, which keeps its order if it has one, and stops. The table holds the number
    of the last batch, so a batch that is played again isn't inserted twice."""
    return rows.writeStream.foreachBatch(lambda batch, number: insert(batch, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
