"""Scores of predictions (w, flow, x, y, predict, real) and sudden changes of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.timing import time_shift
from roadpulse.operators.marks import exclude_no_signal
from roadpulse.operators.panel import panel_times, rank_windows
from roadpulse.session import stage
from roadpulse.spec import CHANGE_THRESHOLD, TOP_CHANGES, WINDOW_MINUTES


def rmse(pred: DataFrame, no_signal: DataFrame | None = None) -> DataFrame:
    """One row: root of the mean squared error over cells with signal."""
    error = F.col("predict") - F.col("real")
    return exclude_no_signal(pred, no_signal).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("values")
    )


def accuracy(pred: DataFrame, no_signal: DataFrame | None = None) -> DataFrame:
    """One row: share of equal values over cells with signal."""
    equal = (F.col("predict") == F.col("real")).cast("double")
    return exclude_no_signal(pred, no_signal).agg(
        F.avg(equal).alias("accuracy"), F.count(F.lit(1)).alias("values")
    )


def frame_change(panel: DataFrame, col: str = "speed") -> DataFrame:
    """(w, diff): distance of each frame from the frame of the window before it.

    Absent cells are 0, and a frame is compared with the previous existing window. A cell's
    value is added to its own window and subtracted from the next one, so the panel needs
    neither filling up nor a join of frames.
    """
    ranked = stage(rank_windows(panel_times(panel)), "windows")
    following = ranked.select((F.col("pos") - 1).alias("pos"), F.col("w").alias("_next"))
    steps = ranked.join(following, "pos", "left").select("w", "_next")
    signed = F.array(
        F.struct(F.col("w").alias("w"), F.col(col).alias("v")),
        F.struct(F.col("_next").alias("w"), (-F.col(col)).alias("v")),
    )
    moved = panel.join(steps, "w").select("x", "y", F.explode(signed).alias("_m"))
    moved = moved.select("x", "y", "_m.w", "_m.v").filter(F.col("w").isNotNull())
    change = moved.groupBy("w", "x", "y").agg(F.sum("v").alias("v"))
    diffs = change.groupBy("w").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("diff"))
    later = ranked.filter(F.col("pos") > 0).select("w")
    return diffs.join(later, "w", "left_semi")


def top_changes(change: DataFrame, top: int = TOP_CHANGES) -> DataFrame:
    """Windows with the largest change; of equal ones the earlier comes first."""
    return change.orderBy(F.col("diff").desc(), "w").limit(top)


def windows_after(times: DataFrame, next_n: int, minutes: int) -> DataFrame:
    """The ``next_n`` windows after each given one; the given ones themselves for 0."""
    if next_n == 0:
        return times.select("w").distinct()
    steps = F.explode(F.sequence(F.lit(1), F.lit(next_n))).alias("_n")
    return times.select("w", steps).select(time_shift(F.col("w"), F.col("_n"), minutes).alias("w")).distinct()


def times_in_set(df: DataFrame, times: DataFrame) -> DataFrame:
    return df.join(times.select("w"), "w", "left_semi")


def compare_after_change(
    change: DataFrame,
    preds: dict[str, DataFrame],
    no_signal: DataFrame | None = None,
    top: int = TOP_CHANGES,
    next_n: int = 2,
    minutes: int = WINDOW_MINUTES,
) -> DataFrame:
    """(model, rmse, values) of each model on the windows right after the largest changes."""
    after = windows_after(top_changes(change, top), next_n, minutes)
    tagged = [p.withColumn("model", F.lit(name)) for name, p in preds.items()]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    error = F.col("predict") - F.col("real")
    return (
        exclude_no_signal(times_in_set(rows, after), no_signal)
        .groupBy("model")
        .agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("values"))
    )


def diff_test_select(
    train: DataFrame, test: DataFrame, change: DataFrame, threshold: float = CHANGE_THRESHOLD
) -> DataFrame:
    """Samples of both parts whose window changed by more than ``threshold``.

    Training rows are among them, so scores on this set are not those of unseen data.
    """
    sudden = change.filter(F.col("diff") > threshold)
    return times_in_set(train.unionByName(test), sudden)


def mean_predictor(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Prediction = mean of the given lag columns."""
    total: Column = F.col(columns[0])
    for name in columns[1:]:
        total = total + F.col(name)
    return features.withColumn("predict", total / len(columns))
