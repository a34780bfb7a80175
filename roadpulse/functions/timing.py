"""Time expressions. Windows are timestamps inside and ``yyyyMMddHHmm`` text at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadpulse.spec import check_window

WINDOW_FORMAT = "yyyyMMddHHmm"
SECOND_FORMAT = "yyyyMMddHHmmss"
DISPLAY_FORMAT = "yyyy/MM/dd HH:mm"


def window_floor(t: Column, minutes: int) -> Column:
    """Start of the window holding ``t``; windows are counted from midnight.

    When ``minutes`` does not divide a day the last window of the day is short, which is why
    this is not ``F.window`` (that one counts from the epoch).
    """
    check_window(minutes)
    past = (F.hour(t) * 60 + F.minute(t)) % minutes
    return F.timestamp_seconds(F.unix_seconds(t) - past * 60 - F.second(t))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from one timestamp to another (may be negative)."""
    return F.unix_seconds(end) - F.unix_seconds(start)


def time_diff(start: Column, end: Column) -> Column:
    """Whole seconds between two 14-character times; any other length is an error."""
    bad = (F.length(start) != 14) | (F.length(end) != 14)
    parsed = seconds_between(F.to_timestamp(start, SECOND_FORMAT), F.to_timestamp(end, SECOND_FORMAT))
    return F.when(bad, F.raise_error(F.lit("time should be yyyyMMddHHmmss")).cast("bigint")).otherwise(parsed)


def epoch_to_timestamp(seconds: Column, offset: str = "+08:00") -> Column:
    """Timestamp whose clock reading is that of ``seconds`` at a fixed UTC offset."""
    sign = -1 if offset.startswith("-") else 1
    hours, minutes = offset.lstrip("+-").split(":")
    shift = sign * (int(hours) * 3600 + int(minutes) * 60)
    clock = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (seconds + shift).cast("decimal(18,6)")
    )
    return clock.cast("timestamp")


def epoch_to_time(seconds: Column, offset: str = "+08:00") -> Column:
    """``yyyyMMddHHmmss`` text of epoch seconds at a fixed UTC offset."""
    return F.date_format(epoch_to_timestamp(seconds, offset), SECOND_FORMAT)


def time_shift(w: Column, n: Column | int, minutes: int) -> Column:
    """The window ``n`` windows later."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.timestamp_seconds(F.unix_seconds(w) + n * (minutes * 60))


def parse_time(text: Column) -> Column:
    return F.to_timestamp(text, WINDOW_FORMAT)


def parse_second(text: Column) -> Column:
    return F.to_timestamp(text, SECOND_FORMAT)


def format_time(w: Column) -> Column:
    return F.date_format(w, WINDOW_FORMAT)


def format_second(t: Column) -> Column:
    return F.date_format(t, SECOND_FORMAT)


def display_time(w: Column) -> Column:
    return F.date_format(w, DISPLAY_FORMAT)
