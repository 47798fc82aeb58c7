import random
from datetime import timedelta

import pytest

from clickloom.functions.spans import Span, asked_span
from clickloom.operators import series
from helpers import naive, plan_of, utc

START = utc(2031, 3, 4, 22, 17)
SCHEMA = "ad_id long, advertiser_id long, minute timestamp, click_count long, updated_at timestamp"
STEPS = {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1)}


def drawn(seed, count=400):
    """Counts of nine ads of three owners over two days, one minute and ad at most once."""
    chance = random.Random(seed)
    places = chance.sample([(ad, m) for ad in range(9) for m in range(2880)], count)
    return [
        (
            ad,
            ad % 3,
            START + timedelta(minutes=m),
            chance.choice([0, 1, 1, 2, 30]),
            START + timedelta(minutes=m, seconds=chance.randrange(600)),
        )
        for ad, m in places
    ]


def floor(moment, unit):
    parts = {"minute": 5, "hour": 4, "day": 3}[unit]
    return utc(*moment.timetuple()[:parts])


def walked(rows, unit, start, end, keep):
    """The sum of every bucket of a range, one bucket after the other."""
    sums, bucket = [], floor(start, unit)
    while bucket < end:
        inside = [r for r in rows if keep(r) and bucket <= r[2] < bucket + STEPS[unit]]
        sums.append((bucket.replace(tzinfo=None), sum(r[3] for r in inside)))
        bucket += STEPS[unit]
    return sums


def points_of(frame):
    return sorted((naive(p.bucket), p.clicks) for p in frame.collect())


@pytest.fixture(scope="module")
def rows():
    return drawn(5)


@pytest.fixture(scope="module")
def counts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    "unit, start, hours",
    [("minute", 0, 7), ("hour", 0, 48), ("day", 0, 48), ("hour", 13, 5), ("minute", 30, 1)],
)
def test_series_against_a_walk_over_the_buckets(counts, rows, unit, start, hours):
    begin = START + timedelta(hours=start)
    end = begin + timedelta(hours=hours)
    span = Span.covering(unit, begin, end)
    low, high = floor(begin, unit), end
    for ad in (0, 4):
        expected = walked(rows, unit, low, high, lambda r: r[0] == ad and r[1] == ad % 3)
        assert points_of(series.ad_series(counts, ad % 3, ad, span)) == expected
    expected = walked(rows, unit, low, high, lambda r: r[1] == 1)
    assert points_of(series.advertiser_series(counts, 1, span)) == expected


def test_sums_by_ad_go_by_clicks_then_number(spark, counts, rows):
    span = Span.covering("day", START, START + timedelta(days=2))
    for owner in range(3):
        sums = {}
        for ad, of, _, clicks, _ in rows:
            if of == owner:
                sums[ad] = sums.get(ad, 0) + clicks
        expected = sorted(((a, n) for a, n in sums.items() if n), key=lambda p: (-p[1], p[0]))
        found = series.by_ad_of(series.advertiser_groups(counts, owner, span))
        assert [tuple(r) for r in found.collect()] == expected
    level = [(ad, 0, START, n, START) for ad, n in ((11, 6), (10, 6), (12, 0), (13, 7))]
    found = series.by_ad_of(
        series.advertiser_groups(spark.createDataFrame(level, SCHEMA), 0, span)
    )
    assert [tuple(r) for r in found.collect()] == [(13, 7), (10, 6), (11, 6)]


def test_totals_and_their_freshness(counts, rows):
    span = Span.covering("hour", START, START + timedelta(hours=20))
    own = [r for r in rows if r[0] == 7 and floor(START, "hour") <= r[2] < floor(START, "hour") + timedelta(hours=21)]
    totals = series.series_totals(series.ad_series(counts, 1, 7, span)).first()
    assert totals.total == sum(r[3] for r in own)
    assert naive(totals.last_updated_at) == max(r[4] for r in own).replace(tzinfo=None)
    foreign = series.series_totals(series.ad_series(counts, 2, 7, span)).first()
    assert (foreign.total, foreign.last_updated_at) == (0, None)


def test_the_default_range_is_the_last_hour(counts, rows):
    now = START + timedelta(hours=9, seconds=41)
    points = points_of(series.ad_series(counts, 0, 3, asked_span("minute", now=now)))
    begin = START + timedelta(hours=8)
    expected = walked(rows, "minute", begin, now, lambda r: r[0] == 3)
    assert points == expected and len(points) == 61


def test_units_agree(counts, rows):
    day = Span.covering("day", START, START + timedelta(days=2))
    check = series.rollup_consistency(counts, day).first()
    total = sum(r[3] for r in rows)
    assert (check.minute_total, check.hour_total, check.day_total, check.consistent) == (
        total,
        total,
        total,
        True,
    )


def test_the_range_is_half_open(spark):
    ends = [(1, 0, START + timedelta(minutes=m), 1, START) for m in (-1, 0, 29, 30)]
    span = Span.covering("minute", START, START + timedelta(minutes=30))
    assert series.in_span(spark.createDataFrame(ends, SCHEMA), span, 0).count() == 2


def test_zero_fill_per_ad(counts, rows):
    end = START + timedelta(hours=6)
    span = Span.covering("hour", START, end)
    filled = series.zero_fill_per(
        series.rollup(series.in_span(counts, span, 2), "hour", "ad_id"), span, "ad_id"
    )
    found = sorted((r.ad_id, naive(r.bucket), r.clicks) for r in filled.collect())
    begin = floor(START, "hour")
    seen = {r[0] for r in rows if r[1] == 2 and begin <= r[2] < begin + timedelta(hours=7)}
    expected = [
        (ad, bucket, clicks)
        for ad in sorted(seen)
        for bucket, clicks in walked(rows, "hour", START, end, lambda r: r[0] == ad)
    ]
    assert found == expected


def test_the_spine_is_capped(spark):
    with pytest.raises(ValueError):
        Span.covering("minute", START, START + timedelta(days=3)).spine(spark)


def test_registered_series_read_only_their_days_and_owner(spark, sf_dir):
    from clickloom.plans import queries

    plan = plan_of(queries.QUERIES["ad_series"](spark, sf_dir))
    assert f"EqualTo(advertiser_id,{queries.OWNER})" in plan and "EqualTo(ad_id" in plan
    assert "GreaterThanOrEqual(minute" in plan
    day = queries.ONE_DAY.days
    assert day[0] == day[1]
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan
