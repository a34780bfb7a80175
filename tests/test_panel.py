"""Panel completion and gap filling."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import gaps, panel
from roadpulse.spec import GridSpec

START = datetime(2024, 1, 1)
STEP = timedelta(minutes=20)
ONE = GridSpec(0.0, 0.0, 1.0, 1.0, 1, 1)
PANEL = "w timestamp, x int, y int, speed double, num long"


def series(spark, *cells):
    rows = [(START + i * STEP, x, 0, float(v), 9) for x, cell in enumerate(cells) for i, v in enumerate(cell)]
    return spark.createDataFrame(rows, PANEL)


def nothing(spark):
    return spark.createDataFrame([], "x int, y int")


def speeds(df):
    rows = df.orderBy("x", "w").collect()
    return [[r["speed"] for r in rows if r["x"] == x] for x in sorted({r["x"] for r in rows})]


@pytest.mark.parametrize(
    ("given", "compat", "expected"),
    [
        ([10, 0, 4, 8, 0, 2], False, [10, 7, 4, 8, 5, 2]),
        ([10, 0, 4, 8, 0, 2], True, [10, 7, 4, 6, 4, 2]),
        ([0, 0, 5, 0], False, [5, 5, 5, 5]),
        ([0, 0, 5, 0], True, [5, 5, 5, 5]),
        ([0, 0.1, 0], False, [0, 0, 0]),
        ([0, 0.1, 0], True, [0, 0, 0]),
    ],
)
def test_known_gaps(spark, given, compat, expected):
    assert speeds(gaps.interpolate_gaps(series(spark, given), nothing(spark), compat=compat)) == [expected]


def looped(values, compat):
    """One pass over a series that closes each gap when its next known value is met."""
    out, known, closed = list(values), None, False
    for i, v in enumerate(values):
        if v < 0.25:
            continue
        gap = i if known is None else i - known - 1
        if gap:
            first = 0 if known is None else known if compat and closed else known + 1
            left = v if known is None else values[known]
            for k in range(first, i):
                out[k] = left + (v - left) / (i - first + 1) * (k - first + 1)
            closed = True
        known = i
    for k in range(0 if known is None else known + 1, len(values)):
        out[k] = 0.0 if known is None else values[known]
    return out


@pytest.mark.parametrize("compat", [False, True])
def test_gaps_of_many_series(spark, compat):
    rng = random.Random(3)
    cells = [[rng.choice([0.0, 0.0, 0.1, float(rng.randrange(1, 30))]) for _ in range(40)] for _ in range(60)]
    got = speeds(gaps.interpolate_gaps(series(spark, *cells), nothing(spark), compat=compat))
    for have, cell in zip(got, cells, strict=True):
        assert have == pytest.approx(looped(cell, compat))
        if not compat:
            assert all(h == v for h, v in zip(have, cell, strict=True) if v >= 0.25)


def test_silent_cells_are_zero(spark):
    silent = spark.createDataFrame([(1, 0)], "x int, y int")
    assert speeds(gaps.interpolate_gaps(series(spark, [3, 0], [3, 0]), silent)) == [[3, 3], [0, 0]]
    assert speeds(gaps.fill_low_weight(series(spark, [3, 0], [3, 0]), silent, threshold=10)) == [[20, 20], [0, 0]]


def test_neighbour_max(spark):
    got = speeds(gaps.neighbour_max_fill(series(spark, [0, 3, 0, 5, 0]), nothing(spark)))
    assert got == [[3, 3, 5, 5, 5]]


def days_panel(spark, sizes):
    """A day of ``n`` windows for each entry; 0 leaves the day out."""
    rows = [
        (START + timedelta(days=d) + i * STEP, 0, 0, 1.0, 1) for d, n in enumerate(sizes) for i in range(n)
    ]
    return spark.createDataFrame(rows, PANEL)


def test_incomplete_days(spark):
    p = days_panel(spark, [72, 20, 0, 21, 72])
    got = [(r["day"].day, r["windows"]) for r in panel.incomplete_days(p, 20).orderBy("day").collect()]
    assert got == [(2, 20), (3, 0)]


def test_filled_calendar_has_no_hole_outside_flagged_days(spark):
    p = days_panel(spark, [72, 20, 0, 30, 72])
    flagged = panel.incomplete_days(p, 20)
    times = panel.fill_windows(p, 20, flagged)
    per_day = {r["d"].day: r["n"] for r in times.groupBy(F.to_date("w").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert per_day == {1: 72, 2: 20, 4: 72, 5: 72}
    left = panel.drop_flagged_days(panel.densify(p, ONE, times), flagged)
    assert left.count() == 3 * 72


def test_days_stop_at_the_first_incomplete_one_in_compat(spark):
    p = days_panel(spark, [72, 50, 72])
    assert panel.complete_days_only(p, 20).count() == 144
    assert panel.complete_days_only(p, 20, compat=True).count() == 72
    late = p.filter(F.col("w") >= F.lit(START + timedelta(minutes=40)))
    assert panel.complete_days_only(late, 20, compat=True).count() == 0


def test_windows_are_ranked_in_time_order(spark):
    p = days_panel(spark, [72, 50, 0, 72])
    ranked = panel.rank_windows(panel.panel_times(p)).orderBy("w").collect()
    assert [r["pos"] for r in ranked] == list(range(194))


def test_cells_never_seen_are_no_signal_cells(spark):
    grid = GridSpec(0.0, 0.0, 1.0, 1.0, 3, 1)
    p = series(spark, [1] * 40, [1] + [0] * 39)
    got = sorted(tuple(r) for r in panel.no_signal_cells(p, grid).collect())
    assert got == [(1, 0), (2, 0)]


def test_panel_info_takes_the_first_of_equal_windows(spark):
    info = panel.panel_info(series(spark, [2, 7, 7, 1, 1]), nothing(spark), ONE).first()
    assert (info["max_w"], info["min_w"]) == (START + STEP, START + 3 * STEP)
    assert (info["with_speed"], info["expected"]) == (5, 5)


def test_preprocess_drops_flagged_days_after_filling(spark):
    p = days_panel(spark, [72, 5, 72]).withColumn("speed", F.when(F.col("w") < F.lit(START + timedelta(hours=24)), 8.0).otherwise(4.0))
    out = panel.preprocess_panel(p, ONE, 20)
    assert out.count() == 144
    assert {r["label"] for r in out.select("label").distinct().collect()} == {1, 2}


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        panel.preprocess_panel(series(spark, [1]), ONE, 20, method="other")
