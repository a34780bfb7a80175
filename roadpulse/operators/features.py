"""Samples for prediction: lagged frames, calendar, holiday and weather columns.

Panels come in long form (w, x, y, value) and dense, optionally with more key columns named in
``by`` (a source, a flow). Lags are matched by time, not by row, so dropped days leave no
false neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.calendar import WEATHER_COLUMNS, WEEKDAY_COLUMNS, calendar_features, weather_flags
from roadpulse.functions.scaling import minmax_fit, minmax_fit_by, minmax_scale, minmax_scale_by
from roadpulse.operators.marks import exclude_no_signal
from roadpulse.operators.panel import (
    complete_days,
    complete_panel,
    complete_times,
    day_of,
    densify,
    grid_frame,
    keep_days,
    panel_times,
    panel_union,
    rank_windows,
)
from roadpulse.session import stage
from roadpulse.spec import GridSpec, windows_per_day

WEATHER_SCALED = ["wind_scaled", "max_t_scaled", "min_t_scaled"]
EXTERNAL_COLUMNS = [*WEEKDAY_COLUMNS, "is_weekday", "holiday", *WEATHER_COLUMNS, *WEATHER_SCALED]


@dataclass(frozen=True)
class Lags:
    """Lag offsets in windows, by feature column."""

    columns: dict[str, int]
    skip: int

    @staticmethod
    def of(
        minutes: int, closeness: int, period: int, trend: int, period_days: int = 1, trend_days: int = 7
    ) -> Lags:
        if closeness + period + trend < 1:
            raise ValueError("at least one lag is needed")
        day = windows_per_day(minutes)
        columns = {f"c{k}": k for k in range(1, closeness + 1)}
        columns |= {f"p{k}": day * period_days * k for k in range(1, period + 1)}
        columns |= {f"t{k}": day * trend_days * k for k in range(1, trend + 1)}
        skip = max(day * trend_days * trend, day * period_days * period, closeness)
        return Lags(columns, skip)


def lag_columns(closeness: int, period: int, trend: int) -> list[str]:
    return (
        [f"c{k}" for k in range(1, closeness + 1)]
        + [f"p{k}" for k in range(1, period + 1)]
        + [f"t{k}" for k in range(1, trend + 1)]
    )


def _by_time(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by, "x", "y").orderBy(F.unix_seconds("w"))


def lag_join(
    panel: DataFrame,
    lags: dict[str, int],
    minutes: int,
    by: Sequence[str] = (),
    value: str = "value",
    skip: int = 0,
) -> DataFrame:
    """Each cell's value with its lagged values, for windows whose lagged windows all exist.

    A lag is a frame of one point in time before the row, so all lags share one shuffle and one
    sort per cell. The panel is dense: a cell has a row in every window there is, and its series
    is as long as the calendar. The first ``skip`` windows have no row.
    """
    series = _by_time(by)
    at = {name: series.rangeBetween(-n * minutes * 60, -n * minutes * 60) for name, n in lags.items()}
    keys = [*by, "w", "x", "y"]
    met = panel.select(
        *keys,
        value,
        F.row_number().over(series).alias("_pos"),
        *[F.max(value).over(frame).alias(name) for name, frame in at.items()],
        *[F.count(F.lit(1)).over(frame).alias(f"_has_{name}") for name, frame in at.items()],
    ).filter(F.col("_pos") > skip)
    for name in lags:
        met = met.filter(F.col(f"_has_{name}") > 0)
    zero = F.lit(0).cast(panel.schema[value].dataType)
    return met.select(*keys, *[F.coalesce(F.col(name), zero).alias(name) for name in (value, *lags)])


def cpt_features(
    panel: DataFrame,
    minutes: int,
    closeness: int = 3,
    period: int = 1,
    trend: int = 1,
    period_days: int = 1,
    trend_days: int = 7,
    by: Sequence[str] = (),
    value: str = "value",
) -> DataFrame:
    """Closeness (c1..), period (p1.., days) and trend (t1.., weeks) lags of each cell.

    All lagged windows must exist, and the first windows of a source, as many as the longest
    lag spans, are skipped by position.
    """
    lags = Lags.of(minutes, closeness, period, trend, period_days, trend_days)
    return lag_join(panel, lags.columns, minutes, by, value, lags.skip)


def holiday_flag(df: DataFrame, holiday: DataFrame, day: str = "date") -> DataFrame:
    """Add ``holiday`` 1/0."""
    days = holiday.select(F.col("date").alias(day)).distinct().withColumn("_holiday", F.lit(1))
    return df.join(days, day, "left").withColumn("holiday", F.coalesce("_holiday", F.lit(0))).drop("_holiday")


def weather_prev_row(weather: DataFrame) -> DataFrame:
    """Weather known on each date: the row before it in the weather table, none for the first."""
    # One row per date, so this window is as long as the calendar.
    rows = Window.partitionBy(F.lit(0)).orderBy("date")
    shifted = [F.lag(c).over(rows).alias(c) for c in weather.columns if c != "date"]
    return weather.select("date", *shifted)


def weather_minmax(slots: DataFrame) -> DataFrame:
    """Scale wind, max_t and min_t to 0..1 over the given slots; a constant column becomes 0."""
    names = ("wind", "max_t", "min_t")
    bounds = [F.struct(F.min(n).cast("double").alias("lo"), F.max(n).cast("double").alias("hi")).alias(n) for n in names]
    limits = slots.agg(F.struct(*bounds)).scalar()
    for name in names:
        lo, hi = limits[name]["lo"], limits[name]["hi"]
        unit = (F.col(name) - lo) / F.nullif(hi - lo, F.lit(0.0))
        slots = slots.withColumn(f"{name}_scaled", F.when(F.col(name).isNotNull(), F.coalesce(unit, F.lit(0.0))))
    return slots


def external_features(
    times: DataFrame, holiday: DataFrame | None, weather: DataFrame | None, calendar: bool = True
) -> DataFrame:
    """Columns per window of what is asked for: 8 calendar, 1 holiday, 10 weather flags and 3 scaled readings.

    Weather is that of the previous weather row and is scaled over the windows asked for.
    Windows whose date has no weather are dropped; the first weather date has no row before it,
    so its flags and readings are null.
    """
    slots = times.select("w").distinct().withColumn("date", day_of())
    columns = calendar_features(F.col("date")) if calendar else []
    if holiday is not None:
        slots = holiday_flag(slots, holiday)
        columns = [*columns, F.col("holiday").cast("int").alias("holiday")]
    if weather is not None:
        slots = weather_minmax(slots.join(weather_prev_row(weather), "date"))
        flags = zip(weather_flags(F.col("weather")), WEATHER_COLUMNS, strict=True)
        columns = [*columns, *[flag.alias(name) for flag, name in flags], *WEATHER_SCALED]
    return slots.select("w", *columns)


def cell_samples(features: DataFrame, external: DataFrame | None, no_signal: DataFrame | None) -> DataFrame:
    """One training row per window and cell that has signal."""
    rows = exclude_no_signal(features, no_signal)
    return rows if external is None else rows.join(external, "w")


def cells_to_frame(
    pred: DataFrame, grid: GridSpec, default: float = 0.0, col: str = "predict", by: Sequence[str] = ()
) -> DataFrame:
    """Predictions of single cells back to full frames; cells without one get ``default``."""
    full = grid_frame(panel_times(pred, by), grid)
    joined = full.join(pred.select(*by, "w", "x", "y", col), [*by, "w", "x", "y"], "left")
    return joined.withColumn(col, F.coalesce(F.col(col), F.lit(default).cast(pred.schema[col].dataType)))


def test_windows(times: DataFrame, len_test: int, by: Sequence[str] = ()) -> DataFrame:
    """The last ``len_test`` windows."""
    return times.orderBy(*[F.col(b).desc() for b in by], F.col("w").desc()).limit(len_test)


test_windows.__test__ = False


def train_test_split_tail(
    samples: DataFrame, len_test: int, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last ``len_test`` windows are the test part."""
    tail = test_windows(panel_times(samples, by), len_test, by)
    keys = [*by, "w"]
    return samples.join(tail, keys, "left_anti"), samples.join(tail, keys, "left_semi")


def sliding_sequences(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], step: int, by: Sequence[str] = ()
) -> DataFrame:
    """For each window the values of the last ``step`` windows, oldest first, per ``keys``.

    Windows are consecutive by position. The first ``step - 1`` windows have no sequence. A
    sequence is a frame over the positions of its keys' rows, so it never exceeds ``step`` values.
    """
    ranked = rank_windows(panel_times(df, by), by)
    last = Window.partitionBy(*by, *keys).orderBy("pos").rangeBetween(1 - step, 0)
    placed = df.join(ranked, [*by, "w"])
    framed = placed.select(*by, "w", *keys, F.collect_list(F.struct(*cols)).over(last).alias("_s"))
    return framed.filter(F.size("_s") == step).select(*by, "w", *keys, *[F.col(f"_s.{c}").alias(f"{c}_seq") for c in cols])


def flow_values(panel: DataFrame, flows: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by.., w, x, y, flow, value): the columns ``flows`` of a panel as rows, numbered in order."""
    rows = F.array(*[F.struct(F.lit(i).alias("flow"), F.col(f).cast("double").alias("value")) for i, f in enumerate(flows)])
    return panel.select(*by, "w", "x", "y", F.inline(rows))


@dataclass(frozen=True)
class Dataset:
    """Train and test samples, and the scaling limits (one row, or one per flow; None when unscaled)."""

    train: DataFrame
    test: DataFrame
    scale: DataFrame | None


def load_dataset(
    panels: Sequence[DataFrame],
    grid: GridSpec,
    minutes: int,
    no_signal: DataFrame,
    len_test: int,
    closeness: int = 3,
    period: int = 1,
    trend: int = 1,
    holiday: DataFrame | None = None,
    weather: DataFrame | None = None,
    scaled: bool = False,
    complete_value: float | None = None,
    trend_days: int = 7,
    compat: bool = False,
    period_days: int = 1,
    calendar: bool = False,
    flows: Sequence[str] = ("speed",),
) -> Dataset:
    """Panels (w, x, y, speed, num) to train and test samples.

    Complete the calendar with ``complete_value`` (a label panel's "clear"; None leaves missing
    windows out, as a panel of speeds needs it). Several ``flows`` become samples of their own,
    told apart by the column ``flow``, with limits and lags per flow. Keep whole days, scale (limits from all but the last ``len_test``
    windows), build lags within each panel, join external columns (each of ``calendar``,
    ``holiday`` and ``weather`` on its own), split off the last ``len_test`` sample windows. Tables read more than once are stored in between.
    """
    by = ["source_id"]
    union = panel_union(panels)
    if complete_value is not None:
        times = complete_times(union, minutes, by)
        dense = complete_panel(union, grid, minutes, no_signal, complete_value, by=by)
    else:
        times = panel_times(union, by)
        dense = densify(union, grid, by=by)
    # Whole days are found on the windows alone, before any cell is built.
    kept = keep_days(dense, complete_days(times, minutes, compat, by), by)
    several = len(flows) > 1
    keys = [*by, "flow"] if several else by
    values = flow_values(kept, flows, by)
    values = stage(values if several else values.drop("flow"), "values")

    scale = None
    if scaled:
        fitted, _ = train_test_split_tail(values, len_test, by)
        scale = minmax_fit_by(fitted, "value", ["flow"]) if several else minmax_fit(fitted, "value")
        values = minmax_scale_by(values, "value", scale, ["flow"]) if several else minmax_scale(values, "value", scale)

    features = cpt_features(values, minutes, closeness, period, trend, period_days, trend_days, keys)
    features = stage(features, "features")
    external = None
    if calendar or holiday is not None or weather is not None:
        external = external_features(panel_times(features), holiday, weather, calendar)
    samples = cell_samples(features, external, no_signal)
    train, test = train_test_split_tail(samples, len_test, by)
    return Dataset(train, test, scale)
