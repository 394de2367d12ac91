"""Positions in a global order without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, write_table


def running_total(rows: DataFrame, keys: list[str], amount: str, total: str, rank: str) -> DataFrame:
    """Adds `total`, the sum of `amount` over all rows before a row in the order of `keys`, and `rank`, their number.

    Rows are range-partitioned and written once; each task adds up its own range, and the sums of the ranges (a
    row per partition) shift them. `keys` must order rows totally, or ties come in any order.
    """
    spark = rows.sparkSession

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, n = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(amount)).to_numpy(zero_copy_only=False).astype("int64")
            ends = values.cumsum()
            size = batch.num_rows
            extra = [pa.array([part] * size, pa.int32()), pa.array(at + ends - values), pa.array(range(n, n + size), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "_part", total, rank])
            at, n = at + int(ends[-1]) if size else at, n + size

    fields = rows.schema.fields
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    path = shared_path(spark, "ordered")
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    write_table(ranged.mapInArrow(local, f"{out}, _part int, `{total}` long, `{rank}` long"), path)
    done = spark.read.parquet(path)
    sums = done.groupBy("_part").agg(F.sum(amount).alias("s"), F.count("*").alias("n")).orderBy("_part").collect()
    at = n = 0
    shifts = []
    for r in sums:
        shifts.append((r["_part"], at, n))
        at, n = at + r["s"], n + r["n"]
    shift = spark.createDataFrame(shifts, "_part int, _at long, _n long")
    moved = done.join(F.broadcast(shift), "_part")  # a row per partition
    return moved.select(*[f.name for f in fields], (F.col(total) + F.col("_at")).alias(total), (F.col(rank) + F.col("_n")).alias(rank))
