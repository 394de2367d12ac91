"""Uniform shuffle into shards of exact sizes.

A matrix of how many rows go from each input partition to each shard is drawn from the multivariate
hypergeometric law, which is the law of those numbers under a uniform shuffle. From 10**9 rows on, where numpy has no such
draw, binomial numbers are drawn until their sum is the wanted one, which gives the same law at any size. Each partition then deals its rows
out by its line of the matrix in random order, the rows are exchanged, and each shard is permuted again, in
buckets of a random key so that a shard isn't one task's work. Shards are written with their rows; positions come
from the written buckets' sizes. Every draw is seeded, so a lost task is done again with the same result.

Sizes are as equal as they can be: counts differ by one at most. Buckets follow the rows and bytes counted, BUCKET_ROWS and
BUCKET_BYTES at most on average, so a task's work doesn't grow with the data. Null texts count no bytes, repeated rows are
dealt out one by one, an empty table gives no rows; further columns travel with their rows, whatever their names (but `shard` and `slot`, which `read_shards` adds, must be new).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, write_table

#: From so many rows on, numpy can't draw from the hypergeometric law.
LARGE = 10**9
BUCKET_ROWS, BUCKET_BYTES = 1_000_000, 64 << 20


def split(left: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
    """How many of n rows, drawn without replacement, go to each of the places left."""
    total = int(left.sum())
    if total < LARGE:
        return draw.multivariate_hypergeometric(left, n, method="marginals")
    if n in (0, total):
        return left * (n > 0)
    if 2 * n > total:  # draw the others
        return left - split(left, total - n, draw)
    block = 1 << 12
    while True:  # binomials with one rate have the hypergeometric law, given their sum
        tries = draw.binomial(left, n / total, (block, len(left)))
        hit = np.flatnonzero(tries.sum(1) == n)
        if len(hit):
            return tries[hit[0]]


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows from each partition (line) to each shard (column), drawn for a uniform shuffle."""
    total = sum(sizes)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    draw = np.random.default_rng([seed, 0])
    out = np.zeros((len(sizes), shards), np.int64)
    for p, n in enumerate(sizes):
        out[p] = split(left, n, draw)
        left -= out[p]
    return out


def _sizes(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(partition, rows, bytes) of each partition that has rows."""
    wide = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in rows.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = reduce(Column.__add__, wide, F.lit(8 * len(rows.columns))).cast("long")
    counted = rows.select(F.spark_partition_id().alias("part"), size.alias("size")).groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return sorted(map(tuple, counted.collect()))  # a row per partition


def _deal(lines: dict[int, list[int]], buckets: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        line = lines.get(part, [])
        draw = np.random.default_rng([seed, 1, part])
        shard = np.repeat(np.arange(len(line), dtype=np.int32), line)
        draw.shuffle(shard)
        at = 0
        for batch in batches:
            n = batch.num_rows
            if at + n > len(shard):
                raise RuntimeError(f"partition {part} has more rows than were counted")
            key = draw.integers(0, 1 << 62, n)
            extra = [pa.array(shard[at : at + n]), pa.array((key % buckets).astype(np.int32)), pa.array(key)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "shard", "bucket", "key"])
            at += n
        if at != len(shard):
            raise RuntimeError(f"partition {part} has fewer rows than were counted")

    return run


def write_shards(rows: DataFrame, shards: int = 8, seed: int = 17, path: str | None = None) -> str:
    """Writes rows to `path`, a folder per shard: columns c0, c1, ... in order, bucket and place (the place in the bucket)."""
    path = path or shared_path(rows.sparkSession, "shards")
    rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])  # no name can clash
    counted = _sizes(rows)
    matrix = communication_matrix([n for _, n, _ in counted], shards, seed)
    n, size = sum(c[1] for c in counted), sum(c[2] for c in counted)
    least = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, math.ceil(max(least, n / BUCKET_ROWS, size / BUCKET_BYTES) / shards))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.mapInArrow(_deal({c[0]: matrix[i].tolist() for i, c in enumerate(counted)}, buckets, seed), f"{fields}, shard int, bucket int, key long")
    tasks = max(least // 2, math.ceil(buckets * shards / 2))
    dealt = dealt.repartition(tasks, "shard", "bucket")
    inner = Window.partitionBy("shard", "bucket").orderBy("key")
    write_table(dealt.withColumn("place", F.row_number().over(inner) - 1).drop("key"), path, "shard")
    return path


def read_shards(rows_like: DataFrame, path: str) -> DataFrame:
    """The written rows with shard and slot, their place in the shard."""
    spark, fields = rows_like.sparkSession, rows_like.schema.fields
    done = spark.read.schema(f"{', '.join(f'c{i} {f.dataType.simpleString()}' for i, f in enumerate(fields))}, bucket int, place int, shard int").parquet(path)
    sizes = done.groupBy("shard", "bucket").count()  # a row per bucket
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    out = done.join(F.broadcast(starts), ["shard", "bucket"])
    return out.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)], "shard", (F.col("start") + F.col("place")).alias("slot"))


def shard_report(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """What the written shards hold, row by row."""
    rows = docs.select("doc_id", "text")
    done = read_shards(rows, write_shards(rows, shards, seed))
    text = F.coalesce("text", F.lit(""))
    return done.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
