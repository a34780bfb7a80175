"""Speed and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadpulse.spec import LABEL_CLEAR, LABEL_GENERAL, LABEL_JAM, LABEL_NONE, LABEL_SLIGHT_JAM


def speed_kmh(speed: Column) -> Column:
    return speed * 3.6


def congestion_label(speed: Column) -> Column:
    """Label of a speed in m/s: 1 up to 15 km/h, 2 up to 30, 3 up to 45, 4 above, 0 for zero.

    Negative speeds have no label (null). Limits are compared in single precision so that
    speeds such as 100 m in 24 s fall on their limit and not beside it.
    """
    v = speed_kmh(speed).cast("float")
    return (
        F.when(v == 0, LABEL_NONE)
        .when((v > 0) & (v <= 15), LABEL_JAM)
        .when((v > 15) & (v <= 30), LABEL_SLIGHT_JAM)
        .when((v > 30) & (v <= 45), LABEL_GENERAL)
        .when(v > 45, LABEL_CLEAR)
    )


def speed_color_bucket(speed: Column, width: float = 15.0, buckets: int = 4) -> Column:
    """Colour index of a speed, null where there is no speed. The top bucket is open."""
    index = F.floor(speed_kmh(speed) / width)
    return F.when(speed > 0, F.least(index, F.lit(buckets - 1).cast("bigint")).cast("int"))


def round_half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("int")


def cell_count(samples: Column, flows: int, cells: int, excluded: int) -> Column:
    """Values held by ``samples`` frames once the excluded cells are left out."""
    return samples * (flows * (cells - excluded))


def sample_count(values: Column, flows: int, cells: int, excluded: int) -> Column:
    """Frames that ``values`` cell values make up."""
    return F.floor(values / (flows * (cells - excluded)))
