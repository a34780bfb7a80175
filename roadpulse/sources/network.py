"""Readers for road network files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions.geo import point, road_class_code


def _fields(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Lines of text files as an array column ``f``."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select("value", F.split("value", sep).alias("f"))


def _field(n: int, kind: str) -> Column:
    return F.trim(F.col("f")[n]).cast(kind)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``id start end length``."""
    schema = "edge_id bigint, s_id bigint, e_id bigint, length double"
    return spark.read.csv(path, sep="\t", schema=schema, mode="FAILFAST")


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``id lon lat``."""
    schema = "vertex_id bigint, lon double, lat double"
    return spark.read.csv(path, sep="\t", schema=schema, mode="FAILFAST")


def read_edges_geo(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Colon-separated edges: 0 id, 4 class code, 7 length, 9 ``LINESTRING (lon lat, ...)``.

    Of the line only the first and last point are kept. Unknown class codes become null, or
    fail the job when ``strict``.
    """
    points = F.split(F.regexp_extract(F.col("f")[9], r"\(([^)]*)\)", 1), ",")

    def lon_lat(text: Column) -> Column:
        parts = F.split(F.trim(text), r"\s+")
        return point(parts[0].cast("double"), parts[1].cast("double"))

    return _fields(spark, path, ":").select(
        _field(0, "bigint").alias("edge_id"),
        lon_lat(points[0]).alias("start"),
        lon_lat(F.element_at(points, -1)).alias("end"),
        _field(7, "int").alias("length"),
        road_class_code(F.col("f")[4], strict).alias("road_class"),
    )


def read_subnet(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated sub-network, by position. Any line naming ``edge_id`` is a header."""
    rows = _fields(spark, path, ",").filter(~F.contains("value", F.lit("edge_id")))
    return rows.select(
        _field(1, "bigint").alias("edge_id"),
        _field(2, "bigint").alias("s_id"),
        _field(3, "bigint").alias("e_id"),
        F.trim(F.col("f")[5]).alias("road_class"),
        _field(7, "int").alias("width"),
        _field(8, "int").alias("length"),
        _field(9, "int").alias("speed_limit"),
    )
