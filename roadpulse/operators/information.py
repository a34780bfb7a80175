"""Entropy, information gain and majority labels, as grouped counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _entropy_of(n: Column, total: Column) -> Column:
    """Entropy in bits from label counts: log2(N) - sum(n log2 n) / N."""
    return F.log2(total) - F.sum(n * F.log2(n)) / total


def entropy(df: DataFrame, label: str) -> DataFrame:
    """One row: entropy of the labels in bits."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(_entropy_of(F.col("n"), F.sum("n")).alias("entropy"))


def value_entropy(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, entropy) from label counts (keys, label, n)."""
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("_n"), _entropy_of(F.col("n"), F.sum("n")).alias("entropy")
    ).withColumnRenamed("_n", "n")


def information_gain(df: DataFrame, attr: str, label: str) -> DataFrame:
    """One row: entropy lost by splitting on ``attr``."""
    counts = df.groupBy(attr, label).agg(F.count(F.lit(1)).alias("n"))
    split = value_entropy(counts, [attr]).agg((F.sum(F.col("n") * F.col("entropy")) / F.sum("n")).alias("rest"))
    whole = entropy(df, label).scalar()
    return split.select((whole - F.col("rest")).alias("gain"))


def majority_label(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(keys, label, confidence, support): the most frequent label, the smallest among equals."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return majority_of_counts(counts, keys, label)


def majority_of_counts(counts: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    return counts.groupBy(*keys).agg(
        F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias(label),
        (F.max("n") / F.sum("n")).alias("confidence"),
        F.sum("n").alias("support"),
    )
