"""Joins of traversals with the road network.

No side is broadcast by hand. A network is as large as its map, so Spark decides by measured
size: a small one is broadcast, a large one is shuffled on the edge id, where adaptive
execution splits the partitions of edges that carry far more traversals than others.
Attributes are joined onto the edges first, so traversals meet one narrow table only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.geo import grid_xy
from roadpulse.spec import GridSpec


def _required(found: Column, value: Column, what: str, key: Column, kind: str) -> Column:
    message = F.concat(F.lit(f"no {what} "), key.cast("string"))
    return F.when(found, value).otherwise(F.raise_error(message).cast(kind))


def edge_lookup(trav: DataFrame, edge: DataFrame, strict: bool = False) -> DataFrame:
    """Add the edge's length. Unknown edges are dropped, or fail the job when ``strict``."""
    lengths = edge.select("edge_id", "length")
    if not strict:
        return trav.join(lengths, "edge_id")
    found = lengths.withColumn("_found", F.lit(True))
    joined = trav.join(found, "edge_id", "left")
    length = _required(F.col("_found"), F.col("length"), "edge", F.col("edge_id"), "double")
    return joined.withColumn("length", length).drop("_found")


def edge_points(edge: DataFrame, vertex: DataFrame) -> DataFrame:
    """Edges with the position of both ends: start_lon, start_lat, end_lon, end_lat."""

    def ends(prefix: str, key: str) -> DataFrame:
        return vertex.select(
            F.col("vertex_id").alias(key),
            F.col("lon").alias(f"{prefix}_lon"),
            F.col("lat").alias(f"{prefix}_lat"),
        )

    return edge.join(ends("start", "s_id"), "s_id").join(ends("end", "e_id"), "e_id")


def edge_starts(edge: DataFrame, vertex: DataFrame, strict: bool = False) -> DataFrame:
    """(edge_id, length, lon, lat) with the position of each edge's first vertex."""
    starts = vertex.select(F.col("vertex_id").alias("s_id"), "lon", "lat")
    edges = edge.select("edge_id", "s_id", "length")
    if not strict:
        return edges.join(starts, "s_id").drop("s_id")
    joined = edges.join(starts.withColumn("_found", F.lit(True)), "s_id", "left")
    for name in ("lon", "lat"):
        value = _required(F.col("_found"), F.col(name), "vertex", F.col("s_id"), "double")
        joined = joined.withColumn(name, value)
    return joined.drop("s_id", "_found")


def edge_start_vertex(
    trav: DataFrame, edge: DataFrame, vertex: DataFrame, strict: bool = False
) -> DataFrame:
    """Add length and the start vertex's lon and lat to each traversal."""
    starts = edge_starts(edge, vertex, strict)
    if not strict:
        return trav.join(starts, "edge_id")
    joined = trav.join(starts.withColumn("_known", F.lit(True)), "edge_id", "left")
    for name in ("length", "lon", "lat"):
        value = _required(F.col("_known"), F.col(name), "edge", F.col("edge_id"), "double")
        joined = joined.withColumn(name, value)
    return joined.drop("_known")


def edge_cells(edge: DataFrame, vertex: DataFrame, grid: GridSpec) -> DataFrame:
    """(edge_id, length, x, y): the grid cell of each edge's first vertex, (-1, -1) outside."""
    starts = edge_starts(edge, vertex)
    return starts.withColumn("_xy", grid_xy(F.col("lon"), F.col("lat"), grid)).select(
        "edge_id", "length", "_xy.x", "_xy.y"
    )


def geo_edge_lookup(trav: DataFrame, edge_geo: DataFrame) -> DataFrame:
    """Add edge_start, edge_end, edge_length and road_class; null where the edge is unknown."""
    columns = edge_geo.select(
        "edge_id",
        F.col("start").alias("edge_start"),
        F.col("end").alias("edge_end"),
        F.col("length").alias("edge_length"),
        "road_class",
    )
    return trav.join(columns, "edge_id", "left")


def subnet_semi(trav: DataFrame, subnet: DataFrame) -> DataFrame:
    """Keep traversals of a sub-network's edges and add their length."""
    return trav.join(subnet.select("edge_id", F.col("length").cast("double")), "edge_id")


def min_section_length(df: DataFrame, metres: float) -> DataFrame:
    return df.filter(F.col("length") >= metres)
