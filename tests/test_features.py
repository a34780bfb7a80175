"""Lags, splits, sequences and scores."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roadpulse.functions import scaling
from roadpulse.operators import evaluate, features, models
from roadpulse.spec import GridSpec

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def hourly(spark, hours, cells=1, by=""):
    rows = [(START + h * HOUR, x, 0, float(100 * x + h)) for h in hours for x in range(cells)]
    return spark.createDataFrame(rows, "w timestamp, x int, y int, value double")


def test_lags_are_matched_by_time(spark):
    panel = hourly(spark, [h for h in range(24 * 9) if h != 100])
    got = features.cpt_features(panel, 60, closeness=2, period=1, trend=1).orderBy("w").collect()
    hours = [int(r["value"]) for r in got]
    # Positions count existing windows, so the first kept window is one hour late.
    want = [h for h in range(169, 216) if h not in (101, 102, 124) and h - 168 != 100]
    assert hours == want
    assert all((r["c1"], r["c2"], r["p1"], r["t1"]) == tuple(float(h - k) for k in (1, 2, 24, 168)) for r, h in zip(got, hours))


def test_a_missing_window_drops_the_frames_that_need_it(spark):
    got = features.lag_join(hourly(spark, [0, 1, 2, 4, 5, 6, 7]), {"c1": 1, "c2": 2}, 60)
    assert sorted(r["value"] for r in got.collect()) == [2.0, 6.0, 7.0]


def test_equal_lags_of_two_families(spark):
    got = features.lag_join(hourly(spark, range(4)), {"c1": 1, "p1": 1}, 60).orderBy("w").collect()
    assert [(r["c1"], r["p1"]) for r in got] == [(0, 0), (1, 1), (2, 2)]


def test_no_lags_is_an_error(spark):
    with pytest.raises(ValueError):
        features.cpt_features(hourly(spark, range(4)), 60, 0, 0, 0)


def test_split_counts_windows_not_rows(spark):
    train, test = features.train_test_split_tail(hourly(spark, range(10), cells=3), 4)
    assert (train.count(), test.count()) == (18, 12)
    assert test.agg(F.min("w")).first()[0] == START + 6 * HOUR


def test_sequences(spark):
    got = features.sliding_sequences(hourly(spark, [0, 1, 3, 4]), ["x", "y"], ["value"], 3).orderBy("w").collect()
    assert [r["value_seq"] for r in got] == [[0, 1, 3], [1, 3, 4]]


def test_external_features_use_the_row_before(spark):
    days = [START.date() + timedelta(days=d) for d in range(4)]
    weather = spark.createDataFrame(
        [(d, i, 7, 0, w) for i, (d, w) in enumerate(zip(days, ["晴", "小雨", "霾", "阴"], strict=True))],
        "date date, max_t long, min_t long, wind long, weather string",
    )
    holiday = spark.createDataFrame([(days[2],)], "date date")
    times = spark.createDataFrame([(START + timedelta(days=d),) for d in range(4)], "w timestamp")
    rows = features.external_features(times, holiday, weather).orderBy("w").collect()
    assert [len(r) - 1 for r in rows] == [22] * 4
    assert [r["holiday"] for r in rows] == [0, 0, 1, 0]
    # The first date has no row before it; a constant reading is 0.
    assert [(r["clear"], r["rain_small"], r["haze"]) for r in rows] == [(None, None, None), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    assert [r["max_t_scaled"] for r in rows] == [None, 0.0, 0.5, 1.0]
    assert [r["min_t_scaled"] for r in rows] == [None, 0.0, 0.0, 0.0]


def test_frame_change_counts_absent_cells_as_zero(spark):
    rows = [(START, 0, 0, 3.0), (START, 1, 0, 4.0), (START + 5 * HOUR, 0, 0, 3.0), (START + 6 * HOUR, 0, 0, 3.0)]
    panel = spark.createDataFrame(rows, "w timestamp, x int, y int, speed double")
    got = [(r["w"], r["diff"]) for r in evaluate.frame_change(panel).orderBy("w").collect()]
    assert got == [(START + 5 * HOUR, 4.0), (START + 6 * HOUR, 0.0)]


def predictions(spark):
    rows = [(START + h * HOUR, 0, x, 0, float(h), float(h + (x == 1))) for h in range(4) for x in range(2)]
    return spark.createDataFrame(rows, "w timestamp, flow int, x int, y int, predict double, real double")


def test_scores(spark):
    pred, silent = predictions(spark), spark.createDataFrame([(1, 0)], "x int, y int")
    assert evaluate.rmse(pred).first()["rmse"] == pytest.approx(math.sqrt(0.5))
    assert evaluate.accuracy(pred).first()["accuracy"] == 0.5
    assert evaluate.rmse(pred, silent).first()["rmse"] == 0.0
    report = models.model_report(pred).first()
    assert report["rmse"] == pytest.approx(math.sqrt(0.5))
    real = [h + x for h in range(4) for x in range(2)]
    mean = sum(real) / 8
    assert report["score"] == pytest.approx(1 - 4 / sum((r - mean) ** 2 for r in real))


def test_scaled_predictions_are_brought_back(spark):
    pred = predictions(spark).withColumn("predict", F.col("predict") / 2 - 1).withColumn("real", F.col("real") / 2 - 1)
    limits = spark.createDataFrame([(0.0, 4.0)], "lo double, hi double")
    assert models.model_report(pred, limits).first()["rmse"] == pytest.approx(math.sqrt(0.5))


def test_compare_after_change(spark):
    change = spark.createDataFrame([(START, 9.0), (START + HOUR, 1.0)], "w timestamp, diff double")
    got = {r["model"]: (r["rmse"], r["values"]) for r in evaluate.compare_after_change(
        change, {"a": predictions(spark), "b": predictions(spark).withColumn("predict", F.col("real"))}, top=1, next_n=2, minutes=60
    ).collect()}
    assert got == {"a": (pytest.approx(math.sqrt(0.5)), 4), "b": (0.0, 4)}
    same = evaluate.compare_after_change(change, {"a": predictions(spark)}, top=2, next_n=0, minutes=60).first()
    assert same["values"] == 4


def test_change_samples_come_from_both_parts(spark):
    panel = hourly(spark, range(6))
    train, test = features.train_test_split_tail(panel, 2)
    change = spark.createDataFrame([(START + h * HOUR, d) for h, d in ((1, 300.0), (3, 200.0), (5, 201.0))], "w timestamp, diff double")
    assert sorted(r["value"] for r in evaluate.diff_test_select(train, test, change).collect()) == [1.0, 5.0]


def test_cells_to_frame(spark):
    grid = GridSpec(0.0, 0.0, 1.0, 1.0, 2, 2)
    pred = spark.createDataFrame([(START, 0, 1, 5)], "w timestamp, x int, y int, predict int")
    rows = features.cells_to_frame(pred, grid, default=0).orderBy("x", "y").collect()
    assert [r["predict"] for r in rows] == [0, 5, 0, 0]


def test_dataset_of_two_panels_keeps_lags_apart(spark):
    rows = [(START + h * HOUR, 0, 0, float(h + 1), 1) for h in range(24 * 10)]
    schema = "w timestamp, x int, y int, speed double, num long"
    first = spark.createDataFrame(rows, schema)
    second = spark.createDataFrame([(w + timedelta(days=10), x, y, s + 1000, n) for w, x, y, s, n in rows], schema)
    grid, silent = GridSpec(0.0, 0.0, 1.0, 1.0, 1, 1), spark.createDataFrame([], "x int, y int")
    ds = features.load_dataset([first, second], grid, 60, silent, 10, scaled=True)
    # Each panel loses its first week and a day of its own.
    assert ds.train.count() + ds.test.count() == 2 * (240 - 168)
    assert ds.test.select("source_id").distinct().first()[0] == 1 and ds.test.count() == 10
    assert tuple(ds.scale.first()) == (1.0, 1230.0)


def test_flows_have_limits_and_lags_of_their_own(spark):
    rows = [(START + h * HOUR, 0, 0, float(h + 1), 1000 - h) for h in range(24 * 10)]
    panel = spark.createDataFrame(rows, "w timestamp, x int, y int, speed double, num long")
    grid, silent = GridSpec(0.0, 0.0, 1.0, 1.0, 1, 1), spark.createDataFrame([], "x int, y int")
    ds = features.load_dataset([panel], grid, 60, silent, 10, scaled=True, flows=("speed", "num"))
    assert sorted(tuple(r) for r in ds.scale.collect()) == [(0, 1.0, 230.0), (1, 771.0, 1000.0)]
    got = {(r["flow"], r["w"]): r for r in ds.train.unionByName(ds.test).collect()}
    assert len(got) == 2 * (240 - 168) and ds.test.count() == 20

    def scaled(v, lo, hi):
        return pytest.approx((v - lo) / (hi - lo) * 2 - 1)

    for h in (168, 200, 239):
        speed, num = got[0, START + h * HOUR], got[1, START + h * HOUR]
        assert (speed["value"], speed["c2"], speed["t1"]) == tuple(scaled(h + 1 - n, 1, 230) for n in (0, 2, 168))
        assert (num["value"], num["c2"], num["t1"]) == tuple(scaled(1000 - h + n, 771, 1000) for n in (0, 2, 168))
    one = features.load_dataset([panel], grid, 60, silent, 10, scaled=True)
    assert "flow" not in one.train.columns
    back = scaling.minmax_inverse_by(ds.test, "value", ds.scale, ["flow"])
    assert {r["flow"]: round(r["value"], 6) for r in back.where(F.col("w") == START + 239 * HOUR).collect()} == {0: 240.0, 1: 761.0}


def test_missing_windows_of_speeds_are_not_filled(spark):
    rows = [(START + h * HOUR, 0, 0, 30.0, 1) for h in range(24 * 10) if h != 230]
    panel = spark.createDataFrame(rows, "w timestamp, x int, y int, speed double, num long")
    grid, silent = GridSpec(0.0, 0.0, 1.0, 1.0, 1, 1), spark.createDataFrame([], "x int, y int")
    ds = features.load_dataset([panel], grid, 60, silent, 10)
    both = ds.train.unionByName(ds.test)
    assert {v for r in both.select("value", "c1", "p1", "t1").collect() for v in r} == {30.0}
    assert START + 230 * HOUR not in {r["w"] for r in both.collect()}
    labels = features.load_dataset([panel], grid, 60, silent, 10, complete_value=4)
    assert {r["value"] for r in labels.train.unionByName(labels.test).collect()} == {30.0, 4.0}


def test_lags_share_one_shuffle(spark):
    plan = features.cpt_features(hourly(spark, range(24 * 8)), 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Exchange SinglePartition") == 0


def test_sequences_need_every_window(spark):
    panel = hourly(spark, range(5), cells=2).where("not (x = 1 and value = 102)")
    got = features.sliding_sequences(panel, ["x", "y"], ["value"], 2).orderBy("x", "w").collect()
    assert [r["value_seq"] for r in got] == [[0, 1], [1, 2], [2, 3], [3, 4], [100, 101], [103, 104]]


def test_external_columns_on_their_own(spark):
    times = spark.createDataFrame([(START,)], "w timestamp")
    holiday = spark.createDataFrame([(START.date(),)], "date date")
    assert features.external_features(times, holiday, None, calendar=False).columns == ["w", "holiday"]
    assert features.external_features(times, None, None).columns == ["w", *features.WEEKDAY_COLUMNS, "is_weekday"]
    assert features.external_features(times, holiday, None, calendar=False).first()["holiday"] == 1
