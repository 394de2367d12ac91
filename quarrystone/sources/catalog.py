"""Catalog text: blocks of BEGIN, table, file, `attribute Type` lines, END."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import DialectError

TYPES = {"Int": T.IntegerType(), "Double": T.DoubleType(), "String": T.StringType()}


def parse_catalog(text: str) -> dict[str, tuple[str, T.StructType]]:
    """Per table: its file and its schema, with columns that are never null."""
    out: dict[str, tuple[str, T.StructType]] = {}
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    at = 0
    while at < len(lines):
        if lines[at] != "BEGIN" or "END" not in lines[at:]:
            raise DialectError(f"expected a block, got {lines[at]!r}")
        end = lines.index("END", at)
        if end - at < 3:
            raise DialectError("a block needs a table and a file")
        fields = []
        for line in lines[at + 3 : end]:
            name, _, kind = line.partition(" ")
            if kind.strip() not in TYPES:
                raise DialectError(f"bad attribute type in {line!r}")
            fields.append(T.StructField(name, TYPES[kind.strip()], False))
        out[lines[at + 1]] = lines[at + 2], T.StructType(fields)
        at = end + 1
    return out


def read_settings(text: str) -> tuple[str, str, str]:
    """Catalog path, folder of stored tables, folder of text files: the first three lines."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if len(lines) < 3:
        raise DialectError("settings need three lines")
    return lines[0], lines[1], lines[2]


def load_all(spark: SparkSession, catalog: dict[str, tuple[str, T.StructType]], text_dir: str, table_dir: str, load: Callable[..., DataFrame]) -> dict[str, DataFrame]:
    """Loads the text file of every table of a catalog into the table folder."""
    return {name: load(spark, f"{text_dir}/{file}", schema, f"{table_dir}/{name}") for name, (file, schema) in catalog.items()}
