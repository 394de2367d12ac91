"""Stored tables (Parquet, unsorted or sorted), `.tbl` text, formatted output.

Sort keys are kept beside the table, in `_order.txt` (files with `_` are no data to Spark).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EMPTY = {T.IntegerType: 0, T.LongType: 0, T.DoubleType: 0.0, T.StringType: ""}


def read_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Text with `|` after each field. Empty fields are 0, 0.0 or '': the model has no nulls."""
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    rows = spark.read.schema(loose).option("sep", "|").option("quote", "").option("ignoreLeadingWhiteSpace", False).csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit(_EMPTY[type(f.dataType)]).cast(f.dataType)).alias(f.name) for f in schema.fields])


def compose(spark: SparkSession, rows: list[tuple[Any, ...]], schema: T.StructType) -> DataFrame:
    """A table of rows in memory."""
    return spark.createDataFrame(rows, schema)


def create_heap(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return open_table(df.sparkSession, path)


def create_sorted(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Range-partitioned and sorted, so that files and row groups hold narrow ranges of the keys."""
    df.orderBy(*keys).write.mode("overwrite").parquet(path)
    _write_order(df.sparkSession, path, keys)
    return open_table(df.sparkSession, path)


def load_tbl(spark: SparkSession, text: str, schema: T.StructType, path: str, keys: list[str] | None = None) -> DataFrame:
    """Bulk load of a text file into a heap table or, with keys, a sorted one."""
    rows = read_tbl(spark, text, schema)
    return create_sorted(rows, path, keys) if keys else create_heap(rows, path)


def _files(spark: SparkSession, *paths: str) -> tuple:
    """The file system of paths, and the paths as it has them."""
    found = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.rstrip("/")) for p in paths]
    return found[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *found


def _recover(spark: SparkSession, path: str) -> None:
    """If a writer was lost while a new table took the old one's place, the old one goes back there."""
    files, now, aside = _files(spark, path, f"{path.rstrip('/')}.replaced")
    if not files.exists(now) and files.exists(aside):
        files.rename(aside, now)


def open_table(spark: SparkSession, path: str) -> DataFrame:
    _recover(spark, path)
    return spark.read.parquet(path)


def order_of(spark: SparkSession, path: str) -> list[str] | None:
    """Sort keys of a stored table; None for a heap."""
    _recover(spark, path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_order.txt")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split("\n")
    finally:
        stream.close()


def _write_order(spark: SparkSession, path: str, keys: list[str]) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_order.txt")
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray("\n".join(keys).encode()))
    finally:
        stream.close()


def insert(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Appends to a heap; a sorted table is merged into a new one and takes the old one's place, by two renames, between which
    the old one lies aside and comes back if the writer is lost. `batch` numbers inserts: one that the table already has is
    left out. A sorted table and its number change together; a heap's number follows the rows."""
    spark = df.sparkSession
    keys = order_of(spark, path)
    if batch is not None and batch <= _read_number(spark, path):
        return
    if keys is None:
        df.write.mode("append").parquet(path)
        _write_number(spark, path, batch)
        return
    merged, aside = (f"{path.rstrip('/')}.{x}" for x in ("merging", "replaced"))
    number = _read_number(spark, path) if batch is None else batch
    create_sorted(merge_sorted(open_table(spark, path), df, keys), merged, keys)
    _write_number(spark, merged, number if number >= 0 else None)
    files, old, new, away = _files(spark, path, merged, aside)
    files.delete(away, True)
    if not (files.rename(old, away) and files.rename(new, old)):
        raise OSError(f"{merged} could not take the place of {path}")
    files.delete(away, True)
    spark.catalog.refreshByPath(path)


def _read_number(spark: SparkSession, path: str) -> int:
    files, where = _files(spark, f"{path.rstrip('/')}/_batch.txt")
    if not files.exists(where):
        return -1
    stream = files.open(where)
    try:
        return int(str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _write_number(spark: SparkSession, path: str, number: int | None) -> None:
    if number is not None:
        files, where = _files(spark, f"{path.rstrip('/')}/_batch.txt")
        stream = files.create(where, True)
        try:
            stream.write(bytearray(str(number).encode()))
        finally:
            stream.close()


def merge_sorted(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(new).orderBy(*keys)


def _shown(df: DataFrame, gap: str, double: str) -> Column:
    text = lambda f: F.format_string(double, F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`").cast("string")
    return F.concat_ws(f",{gap[:1]}", *[F.concat(F.lit(f"{f.name}:{gap}["), text(f), F.lit("]")) for f in df.schema.fields])


def lines(df: DataFrame) -> DataFrame:
    """One text column, `line`: name:[value],name:[value], doubles with six decimals."""
    return df.select(_shown(df, "", "%f").alias("line"))


def printed(df: DataFrame) -> DataFrame:
    """As `lines`, for reading: `name: [value], name: [value]`, doubles with six significant digits."""
    return df.select(_shown(df, " ", "%.6g").alias("line"))


def write_out(df: DataFrame, path: str) -> None:
    lines(df).write.mode("overwrite").text(path)


def drain(df: DataFrame, amount: Column | None = None) -> tuple[int, float | None]:
    """Number of rows and, if asked for, the sum of an expression, in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), (F.sum(amount) if amount is not None else F.lit(None)).alias("s")).first()
    return row["n"], row["s"]
