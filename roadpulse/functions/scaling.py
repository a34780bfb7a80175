"""Min-max scaling. The fitted limits stay a one-row table read as a scalar subquery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minmax_fit(df: DataFrame, col: str) -> DataFrame:
    """One row (lo, hi) for ``col``."""
    return df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))


def _limits(params: DataFrame) -> Column:
    return params.select(F.struct("lo", "hi")).scalar()


def minmax_scale(
    df: DataFrame, col: str, params: DataFrame, low: float = -1.0, high: float = 1.0, out: str | None = None
) -> DataFrame:
    """``col`` mapped linearly so that lo becomes ``low`` and hi becomes ``high``.

    A constant column has no spread to scale and maps to ``low``.
    """
    limits = _limits(params)
    lo, hi = limits["lo"], limits["hi"]
    unit = F.when(hi == lo, F.lit(0.0)).otherwise((F.col(col) - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return df.withColumn(out or col, unit * (high - low) + low)


def minmax_inverse(
    df: DataFrame, col: str, params: DataFrame, low: float = -1.0, high: float = 1.0, out: str | None = None
) -> DataFrame:
    """Undo :func:`minmax_scale`."""
    limits = _limits(params)
    lo, hi = limits["lo"], limits["hi"]
    return df.withColumn(out or col, (F.col(col) - low) / (high - low) * (hi - lo) + lo)


def minmax_fit_by(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """A row (by.., lo, hi) for each key."""
    return df.groupBy(*by).agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))


def minmax_scale_by(df: DataFrame, col: str, params: DataFrame, by: list[str], low: float = -1.0, high: float = 1.0) -> DataFrame:
    """``col`` mapped linearly by the limits of its key; keys without limits drop out."""
    unit = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((F.col(col) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return df.join(params, by).withColumn(col, unit * (high - low) + low).drop("lo", "hi")


def minmax_inverse_by(df: DataFrame, col: str, params: DataFrame, by: list[str], low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Undo :func:`minmax_scale_by`."""
    back = (F.col(col) - low) / (high - low) * (F.col("hi") - F.col("lo")) + F.col("lo")
    return df.join(params, by).withColumn(col, back).drop("lo", "hi")
