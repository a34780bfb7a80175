"""Filling gaps in each cell's series.

Input is a dense panel: every cell has one row per window, so all cells have series of the
same length and that length grows with the calendar, not with traffic. Frames that look ahead
are written as looking back over the reversed order, which Spark evaluates in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.operators.marks import mark_no_signal
from roadpulse.spec import LOW_WEIGHT, LOW_WEIGHT_SPEED, MIN_KNOWN_SPEED


def interpolate_gaps(
    panel: DataFrame,
    no_signal: DataFrame,
    min_speed: float = MIN_KNOWN_SPEED,
    compat: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Replace speeds below ``min_speed`` from the known speeds around them.

    Inside a gap the speed moves linearly by position, before the first known speed it is that
    speed, after the last one that speed, without any it is 0. No-signal cells become 0.

    ``compat``: once a gap of a cell has been closed, each later gap is taken to begin at the
    known value before it, which is then overwritten as well.
    """
    cell = Window.partitionBy(*by, "x", "y")
    forward, backward = cell.orderBy("w"), cell.orderBy(F.col("w").desc())
    before = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = backward.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    rows = panel.withColumn("_i", F.row_number().over(forward) - 1)
    known = F.col("speed") >= min_speed
    rows = rows.withColumn("_known", F.when(known, F.struct(F.col("_i").alias("i"), F.col("speed").alias("v"))))
    rows = rows.withColumn("_p", F.last("_known", ignorenulls=True).over(before))
    if compat:
        # A gap has been closed at or before p when a known value at or before p has a
        # missing neighbour to its left.
        left_missing = F.lag("_known").over(forward).isNull() & (F.col("_i") > 0)
        rows = rows.withColumn("_closes", F.when(known & left_missing, F.col("_i")))
        rows = rows.withColumn("_closed", F.max("_closes").over(before))
        # The known value a later gap overwrites: known, a gap closed so far, next one missing.
        rows = rows.withColumn("_next_known", F.lead("_known").over(forward))
    rows = rows.withColumn("_q", F.last("_known", ignorenulls=True).over(after))
    if compat:
        rows = rows.withColumn("_q_next", F.lag("_q").over(backward))

    p, q, i = F.col("_p"), F.col("_q"), F.col("_i")
    if compat:
        rows = _compat_values(rows)
    else:
        line = p["v"] + (q["v"] - p["v"]) / F.nullif(q["i"] - p["i"], F.lit(0)) * (i - p["i"])
        rows = rows.withColumn(
            "speed",
            F.when(F.col("_known").isNotNull(), F.col("speed"))
            .when(p.isNull() & q.isNull(), 0.0)
            .when(p.isNull(), q["v"])
            .when(q.isNull(), p["v"])
            .otherwise(line),
        )
    helpers = [c for c in rows.columns if c.startswith("_")]
    return mark_no_signal(rows.drop(*helpers), no_signal, "speed")


def _compat_values(rows: DataFrame) -> DataFrame:
    known = F.col("_known").isNotNull()
    p, i = F.col("_p"), F.col("_i")
    # A known value directly before a gap belongs to that gap once an earlier one was closed.
    swallowed = known & F.col("_closed").isNotNull() & F.col("_next_known").isNull()
    q = F.when(known, F.col("_q_next")).otherwise(F.col("_q"))
    rows = rows.withColumn("_end", q)
    end = F.col("_end")
    start = F.when(F.col("_closed").isNotNull(), p["i"]).otherwise(p["i"] + 1)
    share = (i - start + 1) / F.nullif(end["i"] - start + 1, F.lit(0))
    line = p["v"] + (end["v"] - p["v"]) * share
    return rows.withColumn(
        "speed",
        F.when(known & (~swallowed | end.isNull()), F.col("speed"))
        .when(p.isNull() & end.isNull(), 0.0)
        .when(p.isNull(), end["v"])
        .when(end.isNull(), p["v"])
        .otherwise(line),
    )


def fill_low_weight(
    panel: DataFrame, no_signal: DataFrame, threshold: int = LOW_WEIGHT, value: float = LOW_WEIGHT_SPEED
) -> DataFrame:
    """Set speeds seen by fewer than ``threshold`` runs to ``value``; no-signal cells become 0."""
    filled = F.when(F.col("num") < threshold, F.lit(value)).otherwise(F.col("speed"))
    return mark_no_signal(panel.withColumn("speed", filled), no_signal, "speed")


def neighbour_max_fill(panel: DataFrame, no_signal: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Replace a zero speed by the larger of its neighbours in time (the only one at an end).

    Neighbours are the observed values; no-signal cells are left as they are.
    """
    series = Window.partitionBy(*by, "x", "y").orderBy("w")
    around = F.greatest(F.lag("speed").over(series), F.lead("speed").over(series))
    silent = no_signal.select("x", "y").distinct().withColumn("_silent", F.lit(True))
    rows = panel.withColumn("_around", around).join(silent, ["x", "y"], "left")
    zero = F.col("_silent").isNull() & (F.col("speed") == 0)
    filled = F.when(zero, F.coalesce("_around", "speed")).otherwise(F.col("speed"))
    return rows.withColumn("speed", filled).drop("_around", "_silent")
