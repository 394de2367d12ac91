"""Relational operators: thin, lazy compositions that leave every physical choice to Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import Scope, arithmetic, predicate
from ..plans.ast import Cnf, Expr
from ..plans.parser import parse_cnf, parse_func, parse_sort_order
from ..sources.tables import open_table

#: Rows in a block of a join at most, and rows of a partition from which blocks are packed at once.
BLOCK, SPAN = 64, 1 << 14
#: Tasks for each core over which pairs of blocks are dealt.
TASKS = 8


def _cnf(c: Cnf | str) -> Cnf:
    return parse_cnf(c) if isinstance(c, str) else c


def _func(e: Expr | str, precedence: str = "compat") -> Expr:
    return parse_func(e, precedence) if isinstance(e, str) else e


def select(df: DataFrame, where: Cnf | str, strict_types: bool = False) -> DataFrame:
    """Rows that satisfy a predicate."""
    return df.where(predicate(_cnf(where), Scope(df), strict_types))


def select_file(spark: SparkSession, path: str, where: Cnf | str = "") -> DataFrame:
    """Filtered scan of a stored table; the filter reaches the Parquet reader."""
    return select(open_table(spark, path), where)


def project(df: DataFrame, *keep: str | int) -> DataFrame:
    """Columns by name or position, in the order given."""
    return df.select(*[df.columns[k] if isinstance(k, int) else k for k in keep])


def join(left: DataFrame, right: DataFrame, where: Cnf | str = "", hint: str | None = None) -> DataFrame:
    """Inner join: left columns, then right ones. Equalities become keys, the rest is tested on each match; without
    an equality Spark loops over blocks, and an empty predicate gives all pairs. The hint "blocks" is for few keys of many rows
    each (see _block_join); others are Spark's."""
    on = _cnf(where)
    both = Scope(left).columns | Scope(right).columns
    if len(both) != len(left.columns) + len(right.columns):
        raise ValueError("column names of both sides must differ; rename one side")
    if hint == "blocks":
        return _block_join(left, right, on)
    right = right.hint(hint) if hint else right
    if not on:
        return left.crossJoin(right)
    return left.join(right, predicate(on, Scope(left.limit(0).crossJoin(right.limit(0)))), "inner")


def _keys(left: Scope, right: Scope, on: Cnf) -> tuple[list[tuple[str, str]], Cnf]:
    """Equalities of a left and a right column of one type, whose equal values are the same value; the other conditions."""
    keys, rest = [], []
    for clause in on:
        names = clause.names
        own = len(clause.parts) == 1 and clause.parts[0].op == "=" and len(names) == 2
        pair = next(((a, b) for a, b in (names, names[::-1]) if left.has(a) and right.has(b)), None) if own else None
        types = {left.type(pair[0]).simpleString(), right.type(pair[1]).simpleString()} if pair else set()
        if len(types) == 1 and types <= {"string", "tinyint", "smallint", "int", "bigint", "date", "timestamp"}:
            keys.append((left.find(pair[0]), right.find(pair[1])))
        else:
            rest.append(clause)
    return keys, tuple(rest)


def _blocks(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Rows of each key (columns side0, ...) in lists of at most BLOCK, a row per list: what the other columns have, by place."""
    held = [F.col(f"`{c}`").alias(f"{side}{len(keys) + i}") for i, c in enumerate(c for c in df.columns if c not in keys)]
    rows = df.select(*[F.col(f"`{c}`").alias(f"{side}{i}") for i, c in enumerate(keys)], F.struct(F.lit(0).alias(f"{side}_"), *held).alias("row"))
    own = [f"{side}{i}" for i in range(len(keys))]
    lists = rows.dropna(subset=own).withColumn("span", F.expr(f"monotonically_increasing_id() div {SPAN}")).groupBy(*own, "span").agg(F.collect_list("row").alias("rows"))
    parts = F.expr(f"transform(sequence(0, CAST((size(rows) - 1) div {BLOCK} AS INT)), i -> slice(rows, i * {BLOCK} + 1, {BLOCK}))")
    return lists.select(*own, F.explode(parts).alias(side))


def _block_join(left: DataFrame, right: DataFrame, on: Cnf) -> DataFrame:
    """Both sides' rows are packed by key, and blocks are joined. A pair of blocks is small beside the rows that it stands for, so
    pairs are dealt evenly over tasks, however few the keys and many their rows, and unfolded there."""
    keys, rest = _keys(Scope(left), Scope(right), on)
    if not keys:
        raise ValueError("blocks need an equality of two columns of one type, text, whole numbers or times")
    a, b = ([k[i] for k in keys] for i in (0, 1))
    same = reduce(Column.__and__, [F.col(f"a{i}") == F.col(f"b{i}") for i in range(len(keys))])
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism)
    pairs = _blocks(left, a, "a").join(_blocks(right, b, "b"), same).repartition(tasks)
    rows = pairs.select("*", F.inline("a")).select("*", F.inline("b"))
    places = lambda df, own, side: [F.col(f"{side}{i}").alias(c) for i, c in enumerate([*own, *(c for c in df.columns if c not in own)])]
    out = rows.select(*places(left, a, "a"), *places(right, b, "b")).select(*[f"`{c}`" for c in left.columns + right.columns])
    return select(out, rest) if rest else out


def distinct(df: DataFrame) -> DataFrame:
    """Each row once."""
    return df.distinct()


def total(df: DataFrame, expr: Expr | str, distinct_values: bool = False, precedence: str = "compat") -> DataFrame:
    """One row, `sum`; NULL over no rows. Ints sum to a long."""
    return df.agg(_sum(df, expr, distinct_values, precedence))


def group_total(df: DataFrame, keys: list[str], expr: Expr | str, distinct_values: bool = False, distinct_rows: bool = False, precedence: str = "compat") -> DataFrame:
    """`sum`, then the keys. distinct_rows drops repeated input rows first; distinct_values sums each value once per group."""
    rows = df.distinct() if distinct_rows else df
    return rows.groupBy(*keys).agg(_sum(rows, expr, distinct_values, precedence)).select("sum", *keys)


def _sum(df: DataFrame, expr: Expr | str, distinct_values: bool, precedence: str) -> Column:
    value, _ = arithmetic(_func(expr, precedence), Scope(df))
    return (F.sum_distinct(value) if distinct_values else F.sum(value)).alias("sum")


def sort(df: DataFrame, order: list[str] | str, within_partitions: bool = False) -> DataFrame:
    """Rows in ascending order of keys, given as names or as `(a) AND (b)`."""
    keys = parse_sort_order(order) if isinstance(order, str) else order
    return df.sortWithinPartitions(*keys) if within_partitions else df.orderBy(*keys)


def out_of_order(df: DataFrame, order: list[str] | str) -> int:
    """Neighbours in the wrong order, in one pass: each partition is read as it stands, and a partition's last row is compared
    with the first one of the next that has rows."""
    keys = parse_sort_order(order) if isinstance(order, str) else order
    rows = df.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), F.struct(*keys).alias("k"))
    inner = rows.withColumn("before", F.lag("k").over(Window.partitionBy("p").orderBy("i")))
    parts = inner.groupBy("p").agg(F.count_if(F.col("k") < F.col("before")).alias("wrong"), F.min_by("k", "i").alias("first"), F.max_by("k", "i").alias("last"))
    ends = parts.withColumn("before", F.lag("last").over(Window.orderBy("p")))  # a row per partition
    return ends.agg(F.coalesce(F.sum(F.col("wrong") + F.when(F.col("first") < F.col("before"), 1).otherwise(0)), F.lit(0)).alias("n")).first()["n"]
