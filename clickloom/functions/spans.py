"""Requested spans of time as whole buckets, numbered since the epoch.

A span is a granularity and two whole numbers: its first bucket and the one after its last. All a
query needs follows from these: the predicate on a time column, the day folders to read, the row of
buckets for zero-fill, and their count.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values.
SECONDS = {"minute": 60, "hour": 3600, "day": 86400}
MOST_BUCKETS = 1440
USUAL_SECONDS = 3600

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_MICRO = timedelta(microseconds=1)
_CALENDAR = ((datetime.min - datetime(1970, 1, 1)) // _MICRO, (datetime.max - datetime(1970, 1, 1)) // _MICRO)


class SpanError(ValueError):
    """A span that cannot be answered."""


def _micros(moment: datetime) -> int:
    """Microseconds since the epoch."""
    if moment.tzinfo is None or moment.utcoffset() is None:
        raise SpanError(f"{moment} has no zone")
    return (moment - _EPOCH) // _MICRO


@dataclass(frozen=True)
class Span:
    """The buckets from number ``first`` up to, not including, number ``after``."""

    granularity: str
    first: int
    after: int

    def __post_init__(self) -> None:
        if self.granularity not in SECONDS:
            raise SpanError(f"{self.granularity!r} is none of {', '.join(SECONDS)}")
        if self.first >= self.after:
            raise SpanError("a span must hold a bucket")
        low, high = (n * SECONDS[self.granularity] * 1_000_000 for n in (self.first, self.after))
        if low < _CALENDAR[0] or high > _CALENDAR[1]:
            raise SpanError("the span leaves the calendar")

    @classmethod
    def covering(cls, granularity: str, low: datetime, high: datetime) -> Span:
        """The least span that holds every instant from ``low`` to before ``high``."""
        if granularity not in SECONDS:
            raise SpanError(f"{granularity!r} is none of {', '.join(SECONDS)}")
        return cls._of_micros(granularity, _micros(low), _micros(high))

    @classmethod
    def _of_micros(cls, granularity: str, low: int, high: int) -> Span:
        if low >= high:
            raise SpanError("nothing lies from the start to the end")
        width = SECONDS[granularity] * 1_000_000
        return cls(granularity, low // width, -(-high // width))

    @property
    def buckets(self) -> int:
        return self.after - self.first

    def _moment(self, number: int) -> datetime:
        return _EPOCH + timedelta(seconds=number * SECONDS[self.granularity])

    @property
    def start(self) -> datetime:
        return self._moment(self.first)

    @property
    def end(self) -> datetime:
        return self._moment(self.after)

    @property
    def days(self) -> tuple[date, date]:
        """The first and the last UTC day with an instant in the span."""
        return self.start.date(), (self.end - _MICRO).date()

    def holds(self, time: Column) -> Column:
        """Whether a timestamp lies in the span; plain comparisons, which scans understand."""
        return (time >= F.lit(self.start)) & (time < F.lit(self.end))

    def spine(self, spark: SparkSession) -> DataFrame:
        """The start of every bucket, at most ``MOST_BUCKETS`` rows."""
        self.check_size()
        second = F.col("id") * F.lit(SECONDS[self.granularity])
        return spark.range(self.first, self.after, 1, 1).select(
            F.timestamp_seconds(second).alias("bucket")
        )

    def check_size(self, most: int = MOST_BUCKETS) -> Span:
        if self.buckets > most:
            raise SpanError(f"{self.buckets} buckets of a {self.granularity}; {most} may be asked for")
        return self


def asked_span(
    granularity: str,
    since: datetime | None = None,
    until: datetime | None = None,
    *,
    now: datetime,
    most: int = MOST_BUCKETS,
) -> Span:
    """What a request means: up to now unless it says until when, an hour unless it says since when.

    Both ends widen to whole buckets; the limit on buckets is for the widened span.
    """
    if granularity not in SECONDS:
        raise SpanError(f"{granularity!r} is none of {', '.join(SECONDS)}")
    present = _micros(now)
    high = present if until is None else _micros(until)
    low = high - USUAL_SECONDS * 1_000_000 if since is None else _micros(since)
    return Span._of_micros(granularity, low, high).check_size(most)
