"""Time arithmetic. Day counts are floored durations, not calendar differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in microseconds; works for timestamps without a zone."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def floor_days(start: Column | str, end: Column | str) -> Column:
    """Whole days from start to end, rounded towards minus infinity (-0.5 d is -1)."""
    return F.floor(micros_between(start, end) / F.lit(MICROS_PER_DAY)).cast("bigint")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Fractional days from start to end."""
    return micros_between(start, end) / F.lit(float(MICROS_PER_DAY))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(1_000_000.0)


def week_start(ts: Column | str) -> Column:
    """Monday of the week of ``ts``, as a DATE."""
    return F.date_sub(F.to_date(_col(ts)), F.weekday(_col(ts)))


def plus_days(ts: Column | str, days: int) -> Column:
    return _col(ts) + F.make_dt_interval(F.lit(days))


def midnight(ts: Column | str) -> Column:
    return F.to_date(_col(ts)).cast("timestamp_ntz")


def as_timestamp(value) -> Column:
    """A literal (or column) as a zone-free timestamp. Literals reach the Parquet filters."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")
