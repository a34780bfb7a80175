"""The cell speed panel (w, x, y, speed, num): completion, selection and checks.

A panel has at most one row per cell and window. It stays sparse; ``densify`` adds the absent
cells where an operator needs them. Calendars and grids are generated inside Spark with
``sequence`` and ``explode``. Lists of windows and days grow with the calendar only, at most
one row per window length, never with traffic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.geo import cell_id
from roadpulse.functions.labels import congestion_label
from roadpulse.functions.timing import window_floor
from roadpulse.operators.gaps import fill_low_weight, interpolate_gaps
from roadpulse.operators.marks import exclude_no_signal
from roadpulse.session import stage
from roadpulse.spec import (
    INCOMPLETE_DAY_FRACTION,
    LABEL_CLEAR,
    NO_SIGNAL_FRACTION,
    GridSpec,
    check_window,
    windows_per_day,
)


def day_of(w: str = "w") -> Column:
    return F.to_date(F.col(w))


def panel_times(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct windows of a panel (per source when ``by`` names one)."""
    return panel.select(*by, "w").distinct()


def panel_at(panel: DataFrame, w: Column) -> DataFrame:
    """Cells of one window."""
    return panel.filter(F.col("w") == w)


def cell_series(panel: DataFrame, x: int, y: int, n: int = 500) -> DataFrame:
    """The first ``n`` windows of one cell."""
    return panel.filter((F.col("x") == x) & (F.col("y") == y)).orderBy("w").limit(n)


def rank_windows(times: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``pos`` 0, 1, 2, ... in time order to distinct windows (per source).

    Windows are counted within their day, and days are counted up by their sizes, so no task
    sorts more than one day of windows or one row per day.
    """
    times = times.withColumn("_day", day_of())
    in_day = Window.partitionBy(*by, "_day").orderBy("w")
    days = times.groupBy(*by, "_day").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    counted = times.withColumn("_in_day", F.row_number().over(in_day) - 1)
    return (
        counted.join(days, [*by, "_day"])
        .withColumn("pos", F.col("_before") + F.col("_in_day"))
        .drop("_day", "_before", "_in_day")
    )


def incomplete_days(
    panel: DataFrame, minutes: int, fraction: float = INCOMPLETE_DAY_FRACTION, by: Sequence[str] = ()
) -> DataFrame:
    """Days with too few windows, and days without any between the first and the last."""
    least = int(windows_per_day(check_window(minutes)) * fraction)
    days = panel_times(panel, by).groupBy(*by, day_of().alias("day")).agg(F.count(F.lit(1)).alias("windows"))
    span = days.groupBy(*by).agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    every = span.filter(F.col("_first").isNotNull()).select(
        *by, F.explode(F.sequence("_first", "_last")).alias("day")
    )
    counted = every.join(days, [*by, "day"], "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
    return counted.filter(F.col("windows") < least)


def missing_windows(times: DataFrame, minutes: int, by: Sequence[str] = ()) -> DataFrame:
    """Windows between the first and last of ``times`` that are not in it."""
    span = times.groupBy(*by).agg(F.min("w").alias("_first"), F.max("w").alias("_last"))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    days = span.filter(F.col("_first").isNotNull()).select(
        *by,
        "_first",
        "_last",
        F.explode(F.sequence(F.to_date("_first"), F.to_date("_last"))).alias("_day"),
    )
    begin = F.col("_day").cast("timestamp")
    of_day = F.sequence(begin, begin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(24 * 60 - 1)), step)
    every = days.select(*by, "_first", "_last", F.explode(of_day).alias("w"))
    every = every.filter(F.col("w").between(F.col("_first"), F.col("_last"))).drop("_first", "_last")
    return every.join(times, [*by, "w"], "left_anti")


def fill_windows(
    panel: DataFrame, minutes: int, flagged: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """All windows of the completed panel: its own and the missing ones of unflagged days."""
    times = panel_times(panel, by)
    added = missing_windows(times, minutes, by).withColumn("day", day_of())
    added = added.join(flagged.select(*by, "day"), [*by, "day"], "left_anti").drop("day")
    return times.unionByName(added)


def drop_flagged_days(df: DataFrame, flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    kept = df.withColumn("day", day_of()).join(flagged.select(*by, "day"), [*by, "day"], "left_anti")
    return kept.drop("day")


def grid_frame(times: DataFrame, grid: GridSpec) -> DataFrame:
    """One row per window and cell of the grid."""
    xs = F.explode(F.sequence(F.lit(0), F.lit(grid.nx - 1))).alias("x")
    ys = F.explode(F.sequence(F.lit(0), F.lit(grid.ny - 1))).alias("y")
    return times.select("*", xs).select("*", ys)


def densify(
    panel: DataFrame,
    grid: GridSpec,
    times: DataFrame | None = None,
    by: Sequence[str] = (),
    values: Sequence[str] = ("speed", "num"),
) -> DataFrame:
    """The panel with every cell in every window; absent values become 0."""
    times = panel_times(panel, by) if times is None else times
    full = grid_frame(times.select(*by, "w"), grid)
    dense = full.join(panel.select(*by, "w", "x", "y", *values), [*by, "w", "x", "y"], "left")
    for name in values:
        dense = dense.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast(panel.schema[name].dataType)))
    return dense


def complete_panel(
    panel: DataFrame,
    grid: GridSpec,
    minutes: int,
    no_signal: DataFrame,
    value: float = LABEL_CLEAR,
    weight: int = 0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Every window from first to last: added ones hold ``value`` (0 in no-signal cells)."""
    own = densify(panel, grid, by=by)
    added = grid_frame(missing_windows(panel_times(panel, by), minutes, by), grid)
    silent = no_signal.select("x", "y").distinct().withColumn("_silent", F.lit(True))
    speed = F.when(F.col("_silent"), F.lit(0.0)).otherwise(F.lit(float(value)))
    added = added.join(silent, ["x", "y"], "left").select(
        *by,
        "w",
        "x",
        "y",
        speed.cast(panel.schema["speed"].dataType).alias("speed"),
        F.lit(weight).cast(panel.schema["num"].dataType).alias("num"),
    )
    return own.unionByName(added)


def complete_days(
    times: DataFrame, minutes: int, compat: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """(day) of the days that have all their windows.

    ``compat`` also stops at the first day that starts at midnight but is not complete: it and
    all later days are lost.
    """
    whole = windows_per_day(check_window(minutes))
    days = times.groupBy(*by, day_of().alias("day")).agg(
        F.count(F.lit(1)).alias("windows"),
        F.bool_or(F.col("w") == F.col("w").cast("date").cast("timestamp")).alias("from_midnight"),
    )
    good = days.filter(F.col("windows") == whole)
    if compat:
        stop = days.filter((F.col("windows") != whole) & F.col("from_midnight")).groupBy(*by).agg(
            F.min("day").alias("_stop")
        )
        good = good.join(stop, list(by), "left") if by else good.withColumn("_stop", stop.scalar())
        good = good.filter(F.col("_stop").isNull() | (F.col("day") < F.col("_stop")))
    return good.select(*by, "day")


def keep_days(panel: DataFrame, days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return panel.withColumn("day", day_of()).join(days, [*by, "day"], "left_semi").drop("day")


def complete_days_only(
    panel: DataFrame, minutes: int, compat: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """Keep days that have all their windows; for ``compat`` see :func:`complete_days`."""
    return keep_days(panel, complete_days(panel_times(panel, by), minutes, compat, by), by)


def complete_times(panel: DataFrame, minutes: int, by: Sequence[str] = ()) -> DataFrame:
    """Windows of :func:`complete_panel`, without building its cells."""
    times = panel_times(panel, by)
    return times.unionByName(missing_windows(times, minutes, by))


def no_signal_cells(
    panel: DataFrame, grid: GridSpec, threshold: float = NO_SIGNAL_FRACTION, times: DataFrame | None = None
) -> DataFrame:
    """(x, y) of cells with a speed in less than ``threshold`` of all windows.

    ``times`` gives the windows to count against (the panel's own by default); windows of
    flagged days belong to it. Cells never seen are no-signal cells too.
    """
    times = panel_times(panel) if times is None else times
    total = times.agg(F.count(F.lit(1))).scalar()
    heard = panel.filter((F.col("speed") != 0) & (F.col("num") != 0))
    heard = heard.groupBy("x", "y").agg(F.count(F.lit(1)).alias("heard"))
    one = times.sparkSession.range(1).select()
    cells = grid_frame(one, grid)
    counted = cells.join(heard, ["x", "y"], "left").withColumn("heard", F.coalesce("heard", F.lit(0)))
    return counted.filter(F.col("heard") / total < threshold).select("x", "y")


def panel_info(panel: DataFrame, no_signal: DataFrame, grid: GridSpec) -> DataFrame:
    """One row: cells with speed, expected cells, and the extreme speeds with their window.

    Ties go to the earliest window. The panel must be dense for the minimum to see empty cells.
    """
    windows = panel_times(panel).agg(F.count(F.lit(1))).scalar()
    silent = no_signal.select("x", "y").distinct().agg(F.count(F.lit(1))).scalar()
    speed = F.col("speed")
    latest = F.struct(speed, -F.unix_micros("w"))
    info = exclude_no_signal(panel, no_signal).agg(
        F.count_if(speed > 0).alias("with_speed"),
        F.max(speed).alias("max_speed"),
        F.max_by("w", latest).alias("max_w"),
        F.min(speed).alias("min_speed"),
        F.min_by("w", F.struct(speed, "w")).alias("min_w"),
    )
    return info.withColumn("expected", windows * (F.lit(grid.cells) - silent))


def integrity_check(panel: DataFrame, minutes: int) -> DataFrame:
    """One row: first and last window, windows expected between them and windows found.

    ``expected_exclusive`` counts to the last window without it, as the original check did.
    """
    times = panel_times(panel).agg(
        F.min("w").alias("first_w"), F.max("w").alias("last_w"), F.count(F.lit(1)).alias("actual")
    )
    span = F.floor((F.unix_seconds("last_w") - F.unix_seconds("first_w")) / (minutes * 60))
    return times.withColumn("expected_exclusive", span).withColumn("expected", span + 1).withColumn(
        "complete", F.col("expected") == F.col("actual")
    )


def to_labels(panel: DataFrame) -> DataFrame:
    """The panel with speeds replaced by congestion labels; negative speeds are left out."""
    labelled = panel.withColumn("label", congestion_label(F.col("speed"))).drop("speed")
    return labelled.filter(F.col("label").isNotNull())


def label_count(labels: DataFrame) -> DataFrame:
    """One row: how many cells carry a label above 0."""
    return labels.agg(F.count_if(F.col("label") > 0).alias("labelled"))


def panel_union(panels: Sequence[DataFrame]) -> DataFrame:
    """Several panels in one table, told apart by ``source_id``."""
    tagged = [p.withColumn("source_id", F.lit(i)) for i, p in enumerate(panels)]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    return union


def preprocess_panel(
    panel: DataFrame, grid: GridSpec, minutes: int, method: str = "interpolate", compat: bool = False
) -> DataFrame:
    """The whole cleaning chain, to (w, x, y, speed, num, label).

    Flag incomplete days, add missing windows, find no-signal cells, fill the gaps
    (``interpolate`` or ``low_weight``), drop the flagged days, label the speeds. Windows of
    flagged days take part in the filling before they are dropped. The panel should be a stored
    table; its list of windows is stored too, since every step starts from it.
    """
    own = stage(panel_times(panel), "windows")
    flagged = incomplete_days(own, minutes)
    times = fill_windows(own, minutes, flagged)
    silent = no_signal_cells(panel, grid, times=times)
    dense = densify(panel, grid, times)
    if method == "interpolate":
        filled = interpolate_gaps(dense, silent, compat=compat)
    elif method == "low_weight":
        filled = fill_low_weight(dense, silent)
    else:
        raise ValueError(f"unknown method {method!r}")
    cleaned = drop_flagged_days(filled, flagged)
    return cleaned.withColumn("label", congestion_label(F.col("speed")))
