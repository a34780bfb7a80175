"""Trajectories and their traversals.

``trajectory``: one row per trip with its ``path`` array. ``traversal``: one row per driven
edge (traj_id, seq, edge_id, t), seq counted from 0 without holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.timing import epoch_to_timestamp, seconds_between
from roadpulse.operators.ordered import CHUNK, chunk_of, with_next


def trajectory_sequence(traj: DataFrame) -> DataFrame:
    """One row per edge of each path: seq counts from 0, ``is_last`` marks the final edge."""
    opened = traj.select("traj_id", F.size("path").alias("n"), F.posexplode("path").alias("seq", "step"))
    return opened.select(
        "traj_id",
        F.col("seq").cast("bigint").alias("seq"),
        "step.edge_id",
        "step.t",
        (F.col("seq") == F.col("n") - 1).alias("is_last"),
    )


def traversals_2016(traj: DataFrame, offset: str = "+08:00") -> DataFrame:
    """One row per edge of the 2016 form, whose times array ends with the trip's end time.

    Entry and exit times sit in the same record, so no window is needed to pair them.
    """
    n = F.size("edges")
    steps = F.arrays_zip(
        F.col("edges").alias("edge_id"),
        F.slice("times", 1, n).alias("s"),
        F.slice("times", 2, n).alias("e"),
    )
    opened = traj.select(
        "traj_id", "start_pt", "end_pt", "first_len", "last_len",
        n.cast("bigint").alias("n"), F.posexplode(steps).alias("seq", "step"),
    )
    return opened.select(
        "traj_id", F.col("seq").cast("bigint").alias("seq"), "n", "step.edge_id",
        epoch_to_timestamp(F.col("step.s"), offset).alias("t"),
        (F.col("step.e") - F.col("step.s")).alias("seconds"),
        "start_pt", "end_pt", "first_len", "last_len",
    )


def travel_seconds(trav: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``next_t`` and ``seconds`` until the next entry; both null on the last edge."""
    paired = with_next(trav, "traj_id", "seq", {"t": "next_t"}, chunk)
    return paired.withColumn("seconds", seconds_between(F.col("t"), F.col("next_t")))


def drop_last_traversal(timed: DataFrame) -> DataFrame:
    """Leave out each trip's last edge, which has no end time. Needs :func:`travel_seconds`."""
    return timed.filter(F.col("next_t").isNotNull())


def drop_first_last(trav: DataFrame) -> DataFrame:
    """Leave out each trip's first and last edge. Needs ``seq`` and the trip's size ``n``."""
    return trav.filter(F.col("seq").between(1, F.col("n") - 2))


def trajectory_size(
    traj: DataFrame, min_edges: int, max_edges: int, count_id_token: bool = True
) -> DataFrame:
    """Keep trips by size. With ``count_id_token`` the id counts as one more token."""
    size = F.size("path") + (1 if count_id_token else 0)
    return traj.filter(size.between(min_edges, max_edges))


def choose_trajectories(traj: DataFrame, start: Column, end: Column, min_edges: int = 10) -> DataFrame:
    """Whole trips that enter any edge in [start, end)."""
    enters = F.exists("path", lambda step: (step["t"] >= start) & (step["t"] < end))
    return trajectory_size(traj, min_edges, 2**31 - 1).filter(enters)


def choose_traversals(trav: DataFrame, start: Column, end: Column) -> DataFrame:
    """:func:`choose_trajectories` on traversals, for trips too long to hold as one array."""
    hits = trav.filter((F.col("t") >= start) & (F.col("t") < end)).select("traj_id").distinct()
    return trav.join(hits, "traj_id", "left_semi")


def trajectory_polyline(
    trav: DataFrame, starts: DataFrame, max_points: int = 4096
) -> DataFrame:
    """Start points of a trip's edges in order, in parts of at most ``max_points`` points.

    ``starts`` gives lon and lat per edge. A trip of usual length is one part; a very long one
    is continued in parts 1, 2, ... instead of growing one array without limit.
    """
    placed = trav.join(starts.select("edge_id", "lon", "lat"), "edge_id")
    grouped = placed.groupBy("traj_id", chunk_of(F.col("seq"), max_points).alias("part"))
    return grouped.agg(F.array_sort(F.collect_list(F.struct("seq", "t", "lon", "lat"))).alias("points"))
