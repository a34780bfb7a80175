"""Cells without signal: left out of a table, or set to a value in it.

The set has at most one row per grid cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exclude_no_signal(df: DataFrame, no_signal: DataFrame | None) -> DataFrame:
    if no_signal is None:
        return df
    return df.join(no_signal.select("x", "y"), ["x", "y"], "left_anti")


def mark_no_signal(df: DataFrame, no_signal: DataFrame, col: str, value: float = 0) -> DataFrame:
    silent = no_signal.select("x", "y").distinct().withColumn("_silent", F.lit(True))
    marked = F.when(F.col("_silent"), F.lit(value).cast(df.schema[col].dataType)).otherwise(F.col(col))
    return df.join(silent, ["x", "y"], "left").withColumn(col, marked).drop("_silent")
