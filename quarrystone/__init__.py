"""Relational engine for a compact SQL dialect, on PySpark DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, as PYTHONPATH would (a cluster gets it by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark
