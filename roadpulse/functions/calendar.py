"""Calendar and weather expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words looked for in a weather description, in flag order. The five rain
# strengths count only when the description mentions rain.
SKY_WORDS = ("晴", "多云", "阴")
RAIN_WORD = "雨"
RAIN_STRENGTH_WORDS = ("小", "中", "大", "阵", "暴")
LATE_WORDS = ("雪", "霾")

# Wind descriptions.
CALM_WIND = "微风"
WIND_BELOW_WORD = "小于"
WIND_LEVEL_WORD = "级"

WEEKDAY_COLUMNS = [f"weekday_{k}" for k in range(7)]
WEATHER_COLUMNS = [
    "clear",
    "cloudy",
    "overcast",
    "rain_small",
    "rain_medium",
    "rain_large",
    "rain_shower",
    "rain_storm",
    "snow",
    "haze",
]


def calendar_features(day: Column) -> list[Column]:
    """Seven weekday flags (Monday first) and one working-day flag."""
    weekday = F.weekday(day)
    flags = [(weekday == k).cast("int").alias(name) for k, name in enumerate(WEEKDAY_COLUMNS)]
    return [*flags, (weekday < 5).cast("int").alias("is_weekday")]


def weather_flags(text: Column) -> list[Column]:
    """Ten 0/1 flags of a weather description."""

    def has(word: str) -> Column:
        return F.instr(text, word) > 0

    flags = (
        [has(word) for word in SKY_WORDS]
        + [has(RAIN_WORD) & has(word) for word in RAIN_STRENGTH_WORDS]
        + [has(word) for word in LATE_WORDS]
    )
    return [flag.cast("int").alias(name) for flag, name in zip(flags, WEATHER_COLUMNS, strict=True)]


def wind_level(text: Column) -> Column:
    """Wind level of a description: 0 when calm, N-1 for "below N" (not less than 0), otherwise N (0 if none)."""
    level = F.coalesce(F.regexp_extract(text, f"(\\d+){WIND_LEVEL_WORD}", 1).try_cast("int"), F.lit(0))
    return (
        F.when(text == CALM_WIND, 0).when(F.instr(text, WIND_BELOW_WORD) > 0, F.greatest(level - 1, F.lit(0))).otherwise(level)
    )
