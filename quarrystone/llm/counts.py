"""Token counts through a digest cache.

The cache is a Parquet table (version, digest, n_tokens): `version` is a digest of the tokenizer file, `digest`
one of the text's normal form. Counting joins the texts' digests to the cache, encodes each distinct miss once,
appends the new counts and joins again. The normal form only maps null to the empty text, as any other change
could change a count. A cache lives at the path given, or at that of the setting spark.quarrystone.counts, and then serves
later runs too; without either it is a new one in the shared folder, so that a run's cost doesn't hang on earlier ones. Two
writers at once may store a count twice, which readers see through. Repeated rows each get their row, an empty table gives none, further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, slices
from .encoding import piece_counts

#: Bytes of text that are cut into pieces at once: a worker holds about thirty times as much for it.
SLICE = 1 << 20
_CACHE = "version string, digest binary, n_tokens long"


@functools.lru_cache(maxsize=8)
def version_of(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def _count(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counts(path).count
        for rows, texts in slices(batches, budget=SLICE):
            found = count([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(found)), rows.column("digest"), pa.array(found, pa.int64())], names=["version", "digest", "n_tokens"])

    return run


class CountCache:
    """A table of counts at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or spark.conf.get("spark.quarrystone.counts", None) or shared_path(spark, "counts")
        spark.createDataFrame([], _CACHE).write.mode("append").parquet(self.path)  # so that it can be read

    def stored(self, version: str) -> DataFrame:
        rows = self.spark.read.schema(_CACHE).parquet(self.path).where(F.col("version") == version)
        return rows.select("digest", "n_tokens")

    def count(self, docs: DataFrame, tokenizer_path: str) -> DataFrame:
        """(doc_id, n_bytes, n_tokens) of all rows of docs."""
        version = version_of(tokenizer_path)
        text = F.coalesce("text", F.lit(""))
        keyed = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
        # copies go before the exchange; what arrives is one row per digest and task, and is joined to the cache where it lands
        distinct = keyed.select("digest", "text").dropDuplicates(["digest"])
        misses = distinct.join(self.stored(version).hint("shuffle_merge"), "digest", "left_anti")
        misses.mapInArrow(_count(tokenizer_path, version), _CACHE).write.mode("append").parquet(self.path)
        once = self.stored(version).dropDuplicates(["digest"])
        return keyed.select("doc_id", "n_bytes", "digest").join(once, "digest").select("doc_id", "n_bytes", "n_tokens")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, cache: CountCache | None = None) -> DataFrame:
    cache = cache or CountCache(docs.sparkSession)
    return cache.count(docs, tokenizer_path).withColumn("over_limit", F.col("n_tokens") > limit)
