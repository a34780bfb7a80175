"""Known values of the scalar expressions."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roadpulse.functions import calendar, geo, labels, scaling, timing
from roadpulse.spec import REGION_3, GridSpec


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "minutes", "expected"),
    [
        ("20160729074000", 20, "201607290740"),
        ("20160301124501", 50, "201603011230"),
        ("20160301123501", 50, "201603011230"),
        ("20160301125501", 50, "201603011230"),
        ("20160301122201", 50, "201603011140"),
        ("20160301120501", 50, "201603011140"),
        ("20160301235501", 50, "201603012320"),
        ("20160301000501", 5, "201603010005"),
    ],
)
def test_window_floor(spark, text, minutes, expected):
    w = timing.window_floor(timing.parse_second(F.lit(text)), minutes)
    assert value(spark, timing.format_time(w)) == expected


@pytest.mark.parametrize("minutes", [0, 61])
def test_window_floor_rejects_other_lengths(minutes):
    with pytest.raises(ValueError):
        timing.window_floor(F.lit(None), minutes)


@pytest.mark.parametrize(
    ("end", "expected"), [("20160301000000", 3), ("20160229235959", 2), ("20160302000001", 86404)]
)
def test_time_diff(spark, end, expected):
    assert value(spark, timing.time_diff(F.lit("20160229235957"), F.lit(end))) == expected


def test_time_diff_rejects_other_lengths(spark):
    with pytest.raises(PySparkException):
        value(spark, timing.time_diff(F.lit("201602292359"), F.lit("20160301000000")))


@pytest.mark.parametrize(("epoch", "expected"), [(1459999642, "20160407112722"), (1460002237, "20160407121037")])
def test_epoch_to_time(spark, epoch, expected):
    assert value(spark, timing.epoch_to_time(F.lit(epoch))) == expected


def test_epoch_to_time_in_another_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert value(spark, timing.epoch_to_time(F.lit(1459999642))) == "20160407112722"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_grid_xy(spark):
    big = GridSpec(*REGION_3, nx=80, ny=80)
    assert tuple(value(spark, geo.grid_xy(F.lit(116.386463), F.lit(39.845849), big))) == (42, 8)


@pytest.mark.parametrize(
    ("lon", "lat", "expected"),
    [
        (REGION_3[0], REGION_3[1], (0, 0)),
        (REGION_3[2], REGION_3[3], (3, 3)),
        (REGION_3[2], REGION_3[1], (3, 0)),
        (REGION_3[0], REGION_3[3], (0, 3)),
        (REGION_3[0] - 1e-6, REGION_3[1], (-1, -1)),
        (REGION_3[0], REGION_3[3] + 1e-6, (-1, -1)),
        (None, REGION_3[1], (-1, -1)),
    ],
)
def test_grid_borders(spark, lon, lat, expected):
    grid = GridSpec(*REGION_3, nx=4, ny=4)
    xy = geo.grid_xy(F.lit(lon).cast("double"), F.lit(lat), grid)
    assert tuple(value(spark, xy)) == expected


def test_road_class_code(spark):
    assert value(spark, geo.road_class_code(F.lit("0x0b"))) == 11
    assert value(spark, geo.road_class_code(F.lit("0x05"))) is None
    with pytest.raises(PySparkException):
        value(spark, geo.road_class_code(F.lit("0x05"), strict=True))


@pytest.mark.parametrize(
    ("speed", "expected"),
    [(0.0, 0), (1.0, 1), (100 / 24, 1), (4.17, 2), (50 / 6, 2), (12.5, 3), (12.6, 4), (-1.0, None)],
)
def test_congestion_label(spark, speed, expected):
    assert value(spark, labels.congestion_label(F.lit(speed))) == expected


@pytest.mark.parametrize(("speed", "expected"), [(0.0, None), (1.0, 0), (5.0, 1), (60 / 3.6, 3), (99.0, 3)])
def test_color_bucket(spark, speed, expected):
    assert value(spark, labels.speed_color_bucket(F.lit(speed))) == expected


@pytest.mark.parametrize(("v", "expected"), [(0.5, 0), (1.5, 2), (2.5, 2), (-0.5, 0)])
def test_round_half_even(spark, v, expected):
    assert value(spark, labels.round_half_even(F.lit(v))) == expected


@pytest.mark.parametrize(("wind", "level"), [("微风", 0), ("小于3级", 2), ("北风4级", 4), ("无", 0), ("北风10级", 10), ("小于级", 0)])
def test_wind_level(spark, wind, level):
    assert value(spark, calendar.wind_level(F.lit(wind))) == level


def test_weather_flags(spark):
    row = spark.range(1).select(*calendar.weather_flags(F.lit("大雨转阵雨"))).first()
    assert [n for n in calendar.WEATHER_COLUMNS if row[n]] == ["rain_large", "rain_shower"]
    row = spark.range(1).select(*calendar.weather_flags(F.lit("小雪"))).first()
    assert [n for n in calendar.WEATHER_COLUMNS if row[n]] == ["snow"]


def test_scaling_a_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    scaled = scaling.minmax_scale(df, "v", scaling.minmax_fit(df, "v"))
    assert [r["v"] for r in scaled.collect()] == [-1.0, -1.0]
