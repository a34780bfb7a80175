"""Grid and road expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadpulse.spec import ROAD_CLASS_CODES, ROAD_CLASSES, GridSpec


def grid_xy(lon: Column, lat: Column, grid: GridSpec) -> Column:
    """``struct<x int, y int>`` of the cell holding a point, (-1, -1) outside the box.

    All four borders belong to the box; the upper ones fall into the last column or row.
    """
    inside = lon.between(grid.lon0, grid.lon1) & lat.between(grid.lat0, grid.lat1)
    x = F.least(F.floor((lon - grid.lon0) / grid.lon_step), F.lit(grid.nx - 1).cast("bigint"))
    y = F.least(F.floor((lat - grid.lat0) / grid.lat_step), F.lit(grid.ny - 1).cast("bigint"))
    return F.struct(
        F.when(inside, x).otherwise(-1).cast("int").alias("x"),
        F.when(inside, y).otherwise(-1).cast("int").alias("y"),
    )


def cell_id(x: Column, y: Column, grid: GridSpec) -> Column:
    return x * grid.ny + y


def cell_x(cell: Column, grid: GridSpec) -> Column:
    return F.floor(cell / grid.ny).cast("int")


def cell_y(cell: Column, grid: GridSpec) -> Column:
    return F.pmod(cell, F.lit(grid.ny)).cast("int")


def cell_xy(cell: Column, grid: GridSpec) -> Column:
    return F.struct(cell_x(cell, grid).alias("x"), cell_y(cell, grid).alias("y"))


def cell_polygon(x: Column, y: Column, grid: GridSpec) -> Column:
    """Corners of a cell: lower left, upper left, upper right, lower right."""

    def corner(dx: int, dy: int) -> Column:
        return F.struct(
            (F.lit(grid.lon0) + (x + dx) * grid.lon_step).alias("lon"),
            (F.lit(grid.lat0) + (y + dy) * grid.lat_step).alias("lat"),
        )

    return F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0))


def road_class_code(code: Column, strict: bool = False) -> Column:
    """Number of a road class code. Unknown codes give null, or fail the job when ``strict``."""
    table = F.create_map(*[F.lit(v) for pair in ROAD_CLASS_CODES.items() for v in pair])
    number = F.try_element_at(table, code)
    if not strict:
        return number
    unknown = F.concat(F.lit("unknown road class "), F.coalesce(code, F.lit("null")))
    return F.coalesce(number, F.raise_error(unknown).cast("int"))


def in_road_class(road_class: Column, classes: Sequence[int] = ROAD_CLASSES) -> Column:
    """True for a listed class; an unknown road (null) is not in any class."""
    return F.coalesce(road_class.isin(list(classes)), F.lit(False))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def segment_point(seq: Column, n: Column, start: Column, end: Column, edge_start: Column) -> Column:
    """Where the ``seq``-th of ``n`` edges of a trajectory lies.

    The first edge is placed at the trajectory's start, the last one at its end, others at
    their own start; an unknown edge is placed at (-1, -1).
    """
    nowhere = point(F.lit(-1.0), F.lit(-1.0))
    return F.when(seq == 0, start).when(seq == n - 1, end).otherwise(F.coalesce(edge_start, nowhere))
