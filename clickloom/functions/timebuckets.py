"""UTC time buckets as Column expressions. The session zone must be UTC (see ``session``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GRANULARITIES = ("minute", "hour", "day")
STEP_SQL = {"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY"}


def _check(granularity: str) -> str:
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}, not {granularity!r}")
    return granularity


def bucket_floor(ts: Column, granularity: str) -> Column:
    return F.date_trunc(_check(granularity), ts)


def minute_floor(ts: Column) -> Column:
    return bucket_floor(ts, "minute")


def bucket_ceil(ts: Column, granularity: str) -> Column:
    """First bucket boundary at or after ``ts``."""
    start = bucket_floor(ts, granularity)
    return F.when(start == ts, ts).otherwise(start + F.expr(STEP_SQL[granularity]))


def floor_div(number: Column, by: int) -> Column:
    """Whole-number division rounding down, also below zero."""
    return F.call_function("div", number - F.pmod(number, F.lit(by)), F.lit(by))


def floor_to(number: Column, by: int) -> Column:
    """The multiple of ``by`` at or below ``number``."""
    return number - F.pmod(number, F.lit(by))


def rfc3339_ms(ts: Column) -> Column:
    """``2031-03-04T05:06:07.089Z``; digits below the millisecond are cut, not rounded."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
