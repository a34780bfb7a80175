"""Labelled samples and logistic calibration for the text classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.text import fold_of


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, max_rows: int) -> DataFrame:
    """(doc_id, text, label, part) of at most ``max_rows`` labelled rows outside the held-out fold.

    The rows are those of the smallest id hashes, a documented bound for fitting. Equal texts are
    one row. ``part`` (0 to 9) deals them out for fitting and calibration. Rows without a label or
    an id, and ids with contradicting labels, are not used.
    """
    ids = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).where(fold_of(F.col("doc_id"), folds) != held)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(column).alias("label"), F.max(column).alias("_hi")).where("label = _hi")
    # Bounded by max_rows rows of two numbers, so it is broadcast.
    ids = ids.select("_id", F.col("label").cast("int")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy(F.xxhash64("text").alias("text_id")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("label").alias("label"))
    return rows.select("doc_id", "text", "label", F.pmod(F.xxhash64("text_id"), F.lit(10)).cast("int").alias("part"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic model on standardised features, by Newton steps.

    The result is for raw features. One class only gives an intercept near its share.
    """
    if not len(y):
        return np.zeros(x.shape[1] + 1)
    mid, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([np.ones(len(y)), (x - mid) / scale])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 0.1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    raw = w[1:] / scale
    return np.concatenate([[w[0] - raw @ mid], raw])


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
