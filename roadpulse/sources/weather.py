"""Weather and holiday inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: class of the page element that holds a month's days.
LIST_CLASS = "tqtongji2"


def _text(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]*>", ""))


def weather_pages(pages: DataFrame) -> DataFrame:
    """Monthly pages (url, html) to (date, max_t, min_t, weather, wind).

    Each list of the days' element that holds a link is one day: date, highest and lowest
    temperature, weather, wind direction, wind level.
    """
    section = F.regexp_extract("html", rf'(?s)class="[^"]*{LIST_CLASS}[^"]*"[^>]*>(.*?)</div>', 1)
    lists = pages.select(F.explode(F.regexp_extract_all(section, F.lit("(?s)<ul[^>]*>(.*?)</ul>"), F.lit(1))).alias("ul"))
    items = lists.filter(F.contains("ul", F.lit("<a"))).select(
        F.regexp_extract_all("ul", F.lit("(?s)<li[^>]*>(.*?)</li>"), F.lit(1)).alias("li")
    )

    def item(n: int) -> Column:
        return _text(F.get("li", F.lit(n)))

    return items.select(
        F.to_date(F.regexp_replace(item(0), "-", ""), "yyyyMMdd").alias("date"),
        item(1).try_cast("bigint").alias("max_t"),
        item(2).try_cast("bigint").alias("min_t"),
        item(3).alias("weather"),
        item(5).alias("wind"),
    )


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """``date,maxT,minT,weather,wind`` lines, date as ``yyyyMMdd``."""
    schema = "d string, max_t bigint, min_t bigint, weather string, wind string"
    rows = spark.read.csv(path, schema=schema)
    return rows.select(F.to_date("d", "yyyyMMdd").alias("date"), "max_t", "min_t", "weather", "wind")


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """One ``yyyyMMdd`` per line."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.to_date(F.trim("value"), "yyyyMMdd").alias("date")).distinct()
