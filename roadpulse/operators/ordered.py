"""Ordered work on trajectories that stays spread out when one trajectory is huge.

A window over a whole trajectory puts all its rows into one task. Here a trajectory is cut
into chunks of ``CHUNK`` consecutive positions and windows run per (trajectory, chunk). The
rows at a chunk's edge are sent to the neighbouring chunk as well, so that a row always meets
the rows right before and right after it. Positions must be 0, 1, 2, ... per trajectory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 65536
CHUNK_COL = "_chunk"


def chunk_of(seq: Column, chunk: int) -> Column:
    return F.floor(seq / chunk)


def with_edge_copies(df: DataFrame, seq: str, chunk: int, before: bool, after: bool) -> DataFrame:
    """Add ``_chunk`` and copy rows at chunk edges into the chunk that must see them.

    ``before``: a chunk sees the last row of the one before it. ``after``: it sees the first
    row of the next one. Copies are told apart by :func:`is_own`.
    """
    position = F.col(seq)
    own = chunk_of(position, chunk)
    seen_by = [own]
    if before:
        seen_by.append(F.when(position % chunk == chunk - 1, own + 1))
    if after:
        seen_by.append(F.when((position % chunk == 0) & (position > 0), own - 1))
    return df.withColumn(CHUNK_COL, F.explode(F.array_compact(F.array(*seen_by))))


def is_own(seq: str, chunk: int) -> Column:
    """True for a row in its own chunk, false for a copy."""
    return F.col(CHUNK_COL) == chunk_of(F.col(seq), chunk)


def chunk_window(key: str, seq: str) -> WindowSpec:
    return Window.partitionBy(key, CHUNK_COL).orderBy(seq)


def with_next(
    df: DataFrame, key: str, seq: str, columns: dict[str, str], chunk: int = CHUNK
) -> DataFrame:
    """Add the next row's values: ``columns`` maps a column to the name of its successor."""
    order = chunk_window(key, seq)
    seen = with_edge_copies(df, seq, chunk, before=False, after=True)
    for name, successor in columns.items():
        seen = seen.withColumn(successor, F.lead(name).over(order))
    return seen.filter(is_own(seq, chunk)).drop(CHUNK_COL)
