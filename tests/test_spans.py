from datetime import date, datetime, timedelta, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickloom.functions import timebuckets as tb
from clickloom.functions.spans import SECONDS, Span, SpanError, asked_span
from helpers import naive, utc

MOMENTS = st.datetimes(
    datetime(1900, 1, 1), datetime(2200, 1, 1), timezones=st.sampled_from(
        [timezone.utc, timezone(timedelta(hours=5, minutes=45)), timezone(timedelta(hours=-9))]
    )
)
KINDS = st.sampled_from(sorted(SECONDS))


@given(KINDS, MOMENTS, st.timedeltas(timedelta(microseconds=1), timedelta(days=3)))
def test_covering_is_the_least_whole_span(kind, low, length):
    span, step = Span.covering(kind, low, low + length), timedelta(seconds=SECONDS[kind])
    assert span.start <= low < span.start + step
    assert span.end - step < low + length <= span.end
    assert span.start.utcoffset() == timedelta(0) and (span.end - span.start) == span.buckets * step
    assert (span.start - datetime(1970, 1, 1, tzinfo=timezone.utc)) % step == timedelta(0)


@given(KINDS, MOMENTS)
def test_a_request_without_times_is_the_last_hour(kind, now):
    span = asked_span(kind, now=now)
    assert span == Span.covering(kind, now - timedelta(hours=1), now)
    assert span.buckets <= {"minute": 61, "hour": 2, "day": 2}[kind]


def test_days_are_those_with_an_instant():
    noon = utc(2031, 3, 4, 12)
    assert Span.covering("hour", noon, utc(2031, 3, 5)).days == (date(2031, 3, 4), date(2031, 3, 4))
    assert Span.covering("minute", noon, utc(2031, 3, 5, 0, 0, 1)).days[1] == date(2031, 3, 5)


def test_the_limit_counts_widened_buckets():
    low = utc(2031, 3, 4)
    assert asked_span("minute", low, low + timedelta(days=1), now=low).buckets == 1440
    with pytest.raises(SpanError, match="1441"):
        half = low + timedelta(seconds=30)
        asked_span("minute", half, half + timedelta(days=1), now=low)
    assert asked_span("minute", low, low + timedelta(days=1, seconds=1), now=low, most=1441).buckets == 1441


@pytest.mark.parametrize(
    "since, until",
    [
        (utc(2031, 1, 1), utc(2031, 1, 1)),
        (utc(2031, 1, 2), utc(2031, 1, 1)),
        (datetime(2031, 1, 1), None),
        (None, datetime(2031, 1, 1)),
        (None, datetime.max.replace(tzinfo=timezone.utc)),
        (None, datetime.min.replace(tzinfo=timezone.utc)),
    ],
)
def test_requests_that_mean_nothing(since, until):
    with pytest.raises(SpanError):
        asked_span("hour", since, until, now=utc(2031, 1, 1, 7))


def test_unknown_granularities():
    with pytest.raises(SpanError):
        asked_span("fortnight", now=utc(2031, 1, 1))
    with pytest.raises(SpanError):
        Span("fortnight", 1, 2)


def test_columns_agree_with_spans(spark):
    moments = [utc(2031, 3, 4, 5, 6, 7), utc(2031, 3, 4), utc(1961, 7, 8, 23, 58, 59, 5)]
    frame = spark.createDataFrame([(m,) for m in moments], "ts timestamp")
    for kind in tb.GRANULARITIES:
        rows = frame.select(
            "ts",
            tb.bucket_floor(F.col("ts"), kind).alias("low"),
            tb.bucket_ceil(F.col("ts"), kind).alias("high"),
        ).collect()
        for row in rows:
            moment = naive(row.ts).replace(tzinfo=timezone.utc)
            span = Span.covering(kind, moment, moment + timedelta(microseconds=1))
            assert naive(row.low) == span.start.replace(tzinfo=None)
            aligned = span.start == moment
            assert naive(row.high) == (moment if aligned else span.end).replace(tzinfo=None)


def test_spine_and_predicate_are_the_same_buckets(spark):
    span = Span.covering("hour", utc(1969, 12, 31, 20), utc(1970, 1, 1, 3))
    starts = [naive(r.bucket) for r in span.spine(spark).orderBy("bucket").collect()]
    assert starts == [datetime(1969, 12, 31, 20) + timedelta(hours=i) for i in range(7)]
    frame = spark.createDataFrame([(span.start,), (span.end,), (span.end - timedelta(hours=1),)], "t timestamp")
    assert [r[0] for r in frame.select(span.holds(F.col("t"))).collect()] == [True, False, True]


def test_milliseconds_are_cut(spark):
    frame = spark.createDataFrame([(utc(2031, 3, 4, 5, 6, 7, 89999),)], "ts timestamp")
    assert frame.select(tb.rfc3339_ms(F.col("ts"))).first()[0] == "2031-03-04T05:06:07.089Z"
