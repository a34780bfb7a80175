"""Traffic tables derived from the given ``part`` and ``events`` tables.

Parts stand for roads of a lattice network, twenty consecutive events for one trip. Every view
is a deterministic projection, so it grows with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions.geo import point
from roadpulse.spec import REGION_3, GridSpec

GRID = GridSpec(*REGION_3, nx=4, ny=4)
MINUTES = 20
STEPS = 20

# Road class of a part type; other types are class 8.
CLASS_OF_TYPE = {"STANDARD": 0, "SMALL": 1, "LARGE": 2, "ECONOMY": 3, "MEDIUM": 6}

# Weather descriptions by day of year modulo 6.
WEATHER_WORDS = ["晴", "多云", "阴", "小雨", "大雨转阵雨", "霾"]


# Columns used of the given tables; naming them spares a job that looks for the schema.
SCHEMAS = {
    "part": "p_partkey bigint, p_type string, p_size int",
    "events": "event_id bigint, ts timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _road_count(spark: SparkSession, sf_dir: str) -> Column:
    return table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()


def road_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    road_class = F.lit(8)
    for name, code in CLASS_OF_TYPE.items():
        road_class = F.when(F.col("p_type") == name, code).otherwise(road_class)
    return part.select(
        F.col("p_partkey").alias("edge_id"),
        F.col("p_partkey").alias("s_id"),
        ((F.col("p_partkey") + 1) % _road_count(spark, sf_dir)).alias("e_id"),
        (F.col("p_size") * 100).cast("double").alias("length"),
        road_class.cast("int").alias("road_class"),
    )


def road_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("vertex_id"),
        (F.lit(116.25) + F.lit(0.006) * (key % 41)).alias("lon"),
        (F.lit(39.82) + F.lit(0.005) * (F.floor(key / 41) % 37)).alias("lat"),
    )


def traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy trips: (traj_id, seq, edge_id, t)."""
    trip = F.floor(F.col("event_id") / STEPS)
    seq = F.col("event_id") % STEPS
    return table(spark, sf_dir, "events").select(
        trip.alias("traj_id"),
        seq.alias("seq"),
        ((trip * 13 + seq) % _road_count(spark, sf_dir)).alias("edge_id"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("t"),
    )


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy trips with their path; a trip has twenty steps, so the array is bounded."""
    steps = traversal(spark, sf_dir).groupBy("traj_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "t", "edge_id"))).alias("steps")
    )
    path = F.transform("steps", lambda s: F.struct(s["t"].alias("t"), s["edge_id"].alias("edge_id")))
    return steps.select("traj_id", path.alias("path"))


def edge_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2016 edges: (edge_id, start, end, length, road_class)."""
    edge, vertex = road_edge(spark, sf_dir), road_vertex(spark, sf_dir)
    start = vertex.select(F.col("vertex_id").alias("s_id"), point(F.col("lon"), F.col("lat")).alias("start"))
    end = vertex.select(F.col("vertex_id").alias("e_id"), point(F.col("lon"), F.col("lat")).alias("end"))
    return edge.join(start, "s_id").join(end, "e_id").select(
        "edge_id", "start", "end", F.col("length").cast("int").alias("length"), "road_class"
    )


def subnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-network of the road classes 0 to 3."""
    edge = road_edge(spark, sf_dir)
    return edge.filter(F.col("road_class") <= 3).select(
        "edge_id",
        "s_id",
        "e_id",
        F.concat(F.lit("0x0"), F.col("road_class").cast("string")).alias("road_class"),
        F.lit(11).alias("width"),
        F.col("length").cast("int").alias("length"),
        F.lit(40).alias("speed_limit"),
    )


def trajectory_2016(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2016 trips: nineteen edges, twenty times, end points and the driven end lengths.

    Times are epoch seconds whose +08:00 reading is the event's clock time.
    """
    trips = trajectory(spark, sf_dir)
    edges = F.transform(F.slice("path", 1, STEPS - 1), lambda s: s["edge_id"])
    times = F.transform("path", lambda s: F.unix_seconds(s["t"]) - 8 * 3600)
    trips = trips.select("traj_id", edges.alias("edges"), times.alias("times"))
    geo = edge_geo(spark, sf_dir).select("edge_id", "start", (F.col("length") / 2).cast("int").alias("half"))
    first = geo.select(
        F.col("edge_id").alias("first_edge"), F.col("start").alias("start_pt"), F.col("half").alias("first_len")
    )
    last = geo.select(
        F.col("edge_id").alias("last_edge"), F.col("start").alias("end_pt"), F.col("half").alias("last_len")
    )
    trips = trips.withColumn("first_edge", F.col("edges")[0]).withColumn("last_edge", F.element_at("edges", -1))
    return trips.join(first, "first_edge").join(last, "last_edge").drop("first_edge", "last_edge")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, max_t, min_t, wind, weather), one row per day of events."""
    days = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date")).distinct()
    n = F.dayofyear("date")
    top = (F.lit(5) + n * 7 % 11).cast("bigint")
    words = F.array(*[F.lit(w) for w in WEATHER_WORDS])
    return days.select(
        "date",
        top.alias("max_t"),
        (top - 8 - n % 3).cast("bigint").alias("min_t"),
        (n % 5).cast("bigint").alias("wind"),
        words[n % 6].alias("weather"),
    )


def holiday(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date")).distinct()
    return days.filter(F.dayofmonth("date") % 7 == 3)
