"""Statistics per road link and per grid cell over links.

Traversals are summed per (edge, window) before the network is joined, so a road that carries
a large share of all traffic is already reduced to one row per window when rows are matched by
edge id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.timing import window_floor
from roadpulse.operators.network import edge_cells, edge_points, min_section_length
from roadpulse.operators.ordered import CHUNK
from roadpulse.operators.trajectories import drop_first_last, drop_last_traversal, travel_seconds
from roadpulse.spec import COUNT_SPLITS, MAX_SPEED, MIN_SPEED, GridSpec


def link_travel_time(
    trav: DataFrame, edge: DataFrame, minutes: int, min_length: float = 0.0, chunk: int = CHUNK
) -> DataFrame:
    """(edge_id, w, travel_time, num) over edges of at least ``min_length``.

    A traversal belongs to the window of its entry; a trip's last edge is left out.
    """
    timed = drop_last_traversal(travel_seconds(trav.select("traj_id", "seq", "edge_id", "t"), chunk))
    sums = timed.groupBy("edge_id", window_floor(F.col("t"), minutes).alias("w")).agg(
        F.sum("seconds").alias("travel_time"), F.count(F.lit(1)).alias("num")
    )
    long_edges = min_section_length(edge, min_length).select("edge_id")
    return sums.join(long_edges, "edge_id", "left_semi")


def _in_cells(link_stat: DataFrame, edge: DataFrame, vertex: DataFrame, grid: GridSpec) -> DataFrame:
    cells = edge_cells(edge, vertex, grid).filter(F.col("x") >= 0).drop("length")
    return link_stat.join(cells, "edge_id")


def cell_travel_time(link_stat: DataFrame, edge: DataFrame, vertex: DataFrame, grid: GridSpec) -> DataFrame:
    """(w, x, y, travel_time, num): link statistics summed in the cell of the edge's start."""
    return (
        _in_cells(link_stat, edge, vertex, grid)
        .groupBy("w", "x", "y")
        .agg(F.sum("travel_time").alias("travel_time"), F.sum("num").alias("num"))
    )


def cell_link_travel_time(
    link_stat: DataFrame, edge: DataFrame, vertex: DataFrame, grid: GridSpec
) -> DataFrame:
    """(w, x, y, edge_id, travel_time, num)."""
    return (
        _in_cells(link_stat, edge, vertex, grid)
        .groupBy("w", "x", "y", "edge_id")
        .agg(F.sum("travel_time").alias("travel_time"), F.sum("num").alias("num"))
    )


def cell_links_nested(cell_link: DataFrame) -> DataFrame:
    """(w, x, y, links): the links of a cell in one row, ordered by edge id.

    An array is bounded by the roads that start in the cell.
    """
    links = F.array_sort(F.collect_list(F.struct("edge_id", "travel_time", "num")))
    return cell_link.groupBy("w", "x", "y").agg(links.alias("links"))


def cell_edge_count(cell_link: DataFrame) -> DataFrame:
    """Distinct edges per cell over all windows."""
    seen = cell_link.select("x", "y", "edge_id").distinct()
    return seen.groupBy("x", "y").agg(F.count(F.lit(1)).alias("edges"))


def cell_speed_from_links(cell_link: DataFrame, edge: DataFrame, minutes: int) -> DataFrame:
    """(w, x, y, speed): mean over link entries of length per mean travel time.

    Entries without travel time add nothing to the sum but do count in the mean.
    """
    timed = F.nullif(F.col("travel_time"), F.lit(0))
    speed = F.col("length") / (timed / F.col("num"))
    return (
        cell_link.join(edge.select("edge_id", "length"), "edge_id")
        .groupBy(window_floor(F.col("w"), minutes).alias("w"), "x", "y")
        .agg((F.coalesce(F.sum(speed), F.lit(0.0)) / F.count(F.lit(1))).alias("speed"))
    )


def link_speed(
    trav: DataFrame,
    subnet: DataFrame,
    minutes: int,
    low: float = MIN_SPEED,
    high: float = MAX_SPEED,
) -> DataFrame:
    """(edge_id, w, speed, num): mean speed of single traversals of a sub-network's edges.

    First and last edge of a trip are left out, as are traversals without elapsed time or
    outside the speed range. Traversals of equal duration have equal speed, so they are
    counted per (edge, window, duration) before lengths are joined.
    """
    timed = drop_first_last(trav).filter(F.col("seconds") != 0)
    counts = timed.groupBy("edge_id", window_floor(F.col("t"), minutes).alias("w"), "seconds").agg(
        F.count(F.lit(1)).alias("num")
    )
    lengths = subnet.select("edge_id", F.col("length").cast("double").alias("length"))
    speeds = counts.join(lengths, "edge_id").withColumn("speed", F.col("length") / F.col("seconds"))
    return _weighted_mean(speeds.filter(F.col("speed").between(low, high)), F.col("w"))


def _weighted_mean(speeds: DataFrame, w: Column) -> DataFrame:
    return (
        speeds.groupBy("edge_id", w.alias("w"))
        .agg(F.sum(F.col("speed") * F.col("num")).alias("_sum"), F.sum("num").alias("num"))
        .select("edge_id", "w", (F.col("_sum") / F.col("num")).alias("speed"), "num")
    )


def link_speed_rollup(link_speeds: DataFrame, subnet: DataFrame, minutes: int) -> DataFrame:
    """Link speeds of finer windows or a larger network, brought together weighted by count."""
    kept = link_speeds.join(subnet.select("edge_id"), "edge_id", "left_semi")
    return _weighted_mean(kept, window_floor(F.col("w"), minutes))


def road_trip_count(link_stat: DataFrame) -> DataFrame:
    """(edge_id, num): traversals per road over all windows."""
    return link_stat.groupBy("edge_id").agg(F.sum("num").alias("num"))


def min_road_num(counts: DataFrame, minimum: int) -> DataFrame:
    return counts.filter(F.col("num") >= minimum)


def road_class_by_count(
    counts: DataFrame, edge: DataFrame, vertex: DataFrame, splits: Sequence[int] = COUNT_SPLITS
) -> DataFrame:
    """Roads with the largest split not above their count, and both end points.

    Roads below the first split are in no class. One row per road: a class may hold any number
    of roads, so it is not gathered into one list.
    """
    level = F.lit(None).cast("int")
    for split in sorted(splits):
        level = F.when(F.col("num") >= split, F.lit(split)).otherwise(level)
    classed = counts.withColumn("split", level).filter(F.col("split").isNotNull())
    points = edge_points(edge, vertex).select("edge_id", "start_lon", "start_lat", "end_lon", "end_lat")
    return classed.join(points, "edge_id")
