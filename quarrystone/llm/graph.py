"""Connected components by alternating large and small stars, a table per round in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, delete_path, shared_path, write_table


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node that it reaches. Loops, repeats and edges with a
    null are harmless; the result's table goes with `scratch`, if given."""
    spark = edges.sparkSession
    schema = "a long, b long"
    old: list[str] = []

    def keep(df: DataFrame) -> tuple[DataFrame, tuple]:
        old.append(shared_path(spark, "stars"))
        write_table(df, old[-1])
        table = spark.read.schema(schema).parquet(old[-1])
        seen = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for path in old[:-2]:
            delete_path(spark, path)
        del old[:-2]
        return table, tuple(seen)

    now, mark = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        before = mark
        now, mark = keep(small.where("a > b").distinct())
        if mark == before:
            break
    if scratch is not None:
        scratch.paths += old
    # every node now points at its smallest
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
