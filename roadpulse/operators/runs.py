"""Runs: stretches a trip drives inside one grid cell and one time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.geo import grid_xy, in_road_class, segment_point
from roadpulse.functions.timing import seconds_between, window_floor
from roadpulse.operators.network import edge_cells, geo_edge_lookup
from roadpulse.operators.ordered import CHUNK, CHUNK_COL, chunk_window, is_own, with_edge_copies
from roadpulse.spec import MAX_SPEED, MIN_SPEED, ROAD_CLASSES, GridSpec

# Key of the pieces of runs that touch the edge of their chunk.
EDGE_PIECES = -1


def _place(usable: Column, x: Column, y: Column, w: Column) -> Column:
    """Cell and window of a usable step, null for one that ends the run before it."""
    return F.when(usable, F.struct(x.alias("x"), y.alias("y"), w.alias("w"))).alias("place")


def _runs(steps: DataFrame, chunk: int, timed: bool) -> DataFrame:
    """Merge consecutive steps of one cell and window.

    ``steps``: traj_id, seq, length, ``place`` and, when ``timed``, seconds; otherwise t, from
    which the time until the next step is taken. A trip's last step then has none and is left
    out.

    Runs are built per chunk of a trip. A run that crosses a chunk's edge comes out in pieces;
    only those (at most two per chunk) are brought together in a second, small step.
    """
    order = chunk_window("traj_id", "seq")
    own = is_own("seq", chunk)
    seconds = F.col("seconds") if timed else seconds_between(F.col("t"), F.lead("t").over(order))
    seen = with_edge_copies(steps, "seq", chunk, before=True, after=True).withColumns(
        {
            "_before": F.lag("place").over(order),
            "_after": F.lead("place").over(order),
            "_seconds": seconds,
        }
    )
    opens = own & F.col("place").isNotNull() & ~F.col("_before").eqNullSafe(F.col("place"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = F.last(F.when(opens, F.col("seq")), ignorenulls=True).over(so_far)
    goes_on = (F.col("seq") % chunk == chunk - 1) & F.col("_after").eqNullSafe(F.col("place"))

    pieces = (
        seen.withColumn("run_start", started)
        .filter(own & F.col("place").isNotNull() & F.col("_seconds").isNotNull())
        .groupBy("traj_id", CHUNK_COL, "run_start", "place")
        .agg(
            F.count(F.lit(1)).alias("edges"),
            F.sum("length").alias("length"),
            F.sum("_seconds").alias("seconds"),
            F.max(goes_on).alias("_goes_on"),
        )
    )
    touches_edge = F.col("run_start").isNull() | F.col("_goes_on")
    pieces = pieces.withColumn("_group", F.when(touches_edge, F.lit(EDGE_PIECES)).otherwise(F.col(CHUNK_COL)))
    # A piece without a start continues the run left open by the piece before it.
    joined = (
        Window.partitionBy("traj_id", "_group")
        .orderBy(CHUNK_COL, F.col("run_start").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    pieces = pieces.withColumn("run_start", F.last("run_start", ignorenulls=True).over(joined))
    runs = pieces.groupBy("traj_id", "_group", "run_start", "place").agg(
        F.sum("edges").alias("edges"), F.sum("length").alias("length"), F.sum("seconds").alias("seconds")
    )
    return runs.select("traj_id", "run_start", "place.x", "place.y", "place.w", "edges", "length", "seconds")


def cell_runs(
    trav: DataFrame, edge: DataFrame, vertex: DataFrame, grid: GridSpec, minutes: int, chunk: int = CHUNK
) -> DataFrame:
    """Runs of legacy trips: an edge lies in the cell of its first vertex.

    Edges outside the box end a run; a trip's last edge is left out; runs without elapsed time
    are dropped. Speed is total length over total seconds.
    """
    w = window_floor(F.col("t"), minutes)
    steps = trav.join(edge_cells(edge, vertex, grid), "edge_id").select(
        "traj_id", "seq", "t", "length", _place(F.col("x") >= 0, F.col("x"), F.col("y"), w)
    )
    return with_run_speed(_runs(steps, chunk, timed=False))


def with_run_speed(runs: DataFrame) -> DataFrame:
    timed = runs.filter(F.col("seconds") != 0)
    return timed.withColumn("speed", F.col("length") / F.col("seconds"))


def cell_runs_2016(
    trav: DataFrame,
    edge_geo: DataFrame,
    grid: GridSpec,
    minutes: int,
    classes: Sequence[int] = ROAD_CLASSES,
    low: float = MIN_SPEED,
    high: float = MAX_SPEED,
    chunk: int = CHUNK,
) -> DataFrame:
    """Runs of 2016 trips.

    An edge of another road class ends the run before it, so the same cell may hold two runs
    around it. The first and last edge count with their driven part only, and all edges are
    used because the end time is known. Runs outside the speed range are dropped.
    """
    at = segment_point(F.col("seq"), F.col("n"), F.col("start_pt"), F.col("end_pt"), F.col("edge_start"))
    length = (
        F.when(F.col("seq") == 0, F.col("first_len"))
        .when(F.col("seq") == F.col("n") - 1, F.col("last_len"))
        .otherwise(F.col("edge_length"))
    )
    located = geo_edge_lookup(trav, edge_geo).withColumn("_at", at)
    located = located.withColumn("_xy", grid_xy(F.col("_at.lon"), F.col("_at.lat"), grid))
    usable = in_road_class(F.col("road_class"), classes) & (F.col("_xy.x") >= 0)
    steps = located.select(
        "traj_id",
        "seq",
        "seconds",
        length.cast("double").alias("length"),
        _place(usable, F.col("_xy.x"), F.col("_xy.y"), window_floor(F.col("t"), minutes)),
    )
    return speed_range(with_run_speed(_runs(steps, chunk, timed=True)), low, high)


def speed_range(df: DataFrame, low: float = MIN_SPEED, high: float = MAX_SPEED) -> DataFrame:
    """Keep low <= speed <= high."""
    return df.filter(F.col("speed").between(low, high))


def cell_speed(runs: DataFrame) -> DataFrame:
    """Mean run speed per cell and window; every run counts the same.

    Run speeds are added as decimals, so the mean doesn't depend on the order of the rows: one
    that is a whole number comes out as that number and falls into its bin.
    """
    speed = F.col("length").cast("decimal(24,9)") / F.col("seconds").cast("decimal(20,0)")
    return runs.groupBy("w", "x", "y").agg(F.avg(speed).cast("double").alias("speed"), F.count(F.lit(1)).alias("num"))


def cell_speed_from_runs(
    trav: DataFrame, edge: DataFrame, vertex: DataFrame, grid: GridSpec, minutes: int
) -> DataFrame:
    return cell_speed(cell_runs(trav, edge, vertex, grid, minutes))


def cell_speed_from_runs_2016(
    trav: DataFrame,
    edge_geo: DataFrame,
    grid: GridSpec,
    minutes: int,
    classes: Sequence[int] = ROAD_CLASSES,
    low: float = MIN_SPEED,
    high: float = MAX_SPEED,
) -> DataFrame:
    return cell_speed(cell_runs_2016(trav, edge_geo, grid, minutes, classes, low, high))
