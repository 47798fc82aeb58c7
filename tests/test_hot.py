import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from clickloom.operators import hot
from helpers import naive, utc

T0 = int(utc(2026, 9, 26, 12).timestamp())
RULES = hot.HotRules()


def clicks(spark, groups):
    """``(ad, second, how many)`` as one row per click."""
    frame = spark.createDataFrame([(ad, T0 + second, n) for ad, second, n in groups], "ad_id long, t long, n int")
    return frame.select(
        "ad_id", F.timestamp_seconds("t").alias("clicked_at"), F.explode(F.sequence(F.lit(1), "n")).alias("i")
    ).drop("i")


def markings(spark, groups, rules=RULES):
    found = hot.hot_intervals(clicks(spark, groups), rules).orderBy("ad_id", "mark_no").collect()
    def second(moment):
        return int(naive(moment).replace(tzinfo=timezone.utc).timestamp()) - T0
    return [(r.ad_id, r.mark_no, second(r.marked_at), second(r.hot_until), r.permanent) for r in found]


def test_hot_at_the_threshold_over_ten_minutes(spark):
    nearly = [(42, 60 * m, 120) for m in range(9)] + [(42, 540, 119)]
    assert markings(spark, nearly) == []
    assert markings(spark, nearly + [(42, 541, 1)]) == [(42, 1, 541, 1141, False)]


def test_old_buckets_do_not_count(spark):
    assert markings(spark, [(42, 0, 1000), (42, 600, 300)]) == []


def test_still_hot_extends_the_marking(spark):
    assert markings(spark, [(42, 0, 1200), (42, 1, 1), (42, 2, 1)]) == [(42, 1, 0, 602, False)]


def test_a_mark_ends_exactly_after_the_ttl(spark):
    rules = hot.HotRules(bucket_seconds=60, window_buckets=20, threshold=10, ttl_seconds=600)
    assert markings(spark, [(1, 0, 10), (1, 599, 1)], rules) == [(1, 1, 0, 1199, False)]
    assert len(markings(spark, [(1, 0, 10), (1, 600, 1)], rules)) == 2


def test_permanent_from_the_tenth_marking(spark):
    groups = [(42, 3600 * n, 1200) for n in range(11)]
    found = markings(spark, groups)
    assert [m[1] for m in found] == list(range(1, 12))
    assert [m[4] for m in found] == [False] * 9 + [True] * 2
    data = clicks(spark, groups)
    since = hot.permanent_hot(hot.hot_intervals(data)).first().permanent_since
    assert naive(since) == datetime.fromtimestamp(T0 + 9 * 3600, timezone.utc).replace(tzinfo=None)


def _view(spark, groups, second):
    as_of = datetime.fromtimestamp(T0 + second, timezone.utc)
    view = hot.hot_view(hot.hot_intervals(hot.up_to(clicks(spark, groups), as_of)), as_of)
    return [(r.ad_id, r.permanent, r.marks, r.hot_until and naive(r.hot_until)) for r in view.collect()]


def test_view_lists_live_and_permanent_ads(spark):
    groups = [(42, 3600 * n, 1200) for n in range(10)] + [(43, 32_400, 1300), (44, 0, 1300)]
    end = datetime.fromtimestamp(T0 + 33_000, timezone.utc).replace(tzinfo=None)
    # inclusive at hot_until
    assert _view(spark, groups, 33_000) == [(42, True, 10, end), (43, False, 1, end)]
    assert _view(spark, groups, 33_001) == [(42, True, 10, None)]
    # the view knows only what had happened by then
    assert _view(spark, groups, 7200) == [
        (42, False, 3, datetime.fromtimestamp(T0 + 7800, timezone.utc).replace(tzinfo=None))
    ]


def _simulate(groups, rules):
    """Counters and flag of each ad, second by second."""
    found = []
    for ad in sorted({g[0] for g in groups}):
        per_second = {}
        for a, second, n in groups:
            if a == ad:
                per_second[T0 + second] = per_second.get(T0 + second, 0) + n
        buckets, marks = {}, []
        for t in sorted(per_second):
            b = t // rules.bucket_seconds
            buckets[b] = buckets.get(b, 0) + per_second[t]
            total = sum(buckets.get(b - i, 0) for i in range(rules.window_buckets))
            if total < rules.threshold:
                continue
            if marks and t - marks[-1][1] < rules.ttl_seconds:
                marks[-1][1] = t
            else:
                marks.append([t, t])
        for number, (first, last) in enumerate(marks, 1):
            found.append(
                (ad, number, first - T0, last + rules.ttl_seconds - T0, number >= rules.permanent_after)
            )
    return found


@pytest.mark.parametrize("seed, stretch, threshold", [(1, 10, 30), (2, 12, 35), (3, 720, 28), (4, 17, 25)])
def test_random_traffic_equals_the_simulation(spark, seed, stretch, threshold):
    pick = random.Random(seed)
    rules = hot.HotRules(
        bucket_seconds=60, window_buckets=10, threshold=threshold, ttl_seconds=600,
        permanent_after=3, stretch_buckets=stretch,
    )
    groups = [(pick.choice([1, 1, 1, 2]), pick.randrange(0, 50_000), pick.randint(1, 3)) for _ in range(2500)]
    wanted = _simulate(groups, rules)
    assert wanted and markings(spark, groups, rules) == wanted


def test_sliding_total_sees_missing_buckets_as_empty(spark):
    data = clicks(spark, [(1, 0, 3), (1, 540, 4), (1, 600, 5)])
    got = hot.sliding_totals(data).orderBy("bucket").collect()
    assert [(r.n, r.total) for r in got] == [(3, 3), (4, 7), (5, 9)]


def test_tagging_adds_no_rows_and_honours_the_delay(spark):
    groups = [(42, 0, 1200), (42, 1, 1), (42, 5, 1), (42, 601, 1), (42, 700, 1), (43, 5, 1)]
    data = clicks(spark, groups)
    intervals = hot.hot_intervals(data)
    tagged = hot.tag_hot_clicks(data, intervals, visible_after=2)
    assert tagged.count() == data.count()
    hot_seconds = {
        int(naive(r.clicked_at).replace(tzinfo=timezone.utc).timestamp()) - T0
        for r in tagged.where("hot").collect()
    }
    assert hot_seconds == {5, 601}
    share = {r.ad_id: r.hot_share for r in hot.hot_share(tagged).collect()}
    assert share[43] == 0 and share[42] == pytest.approx(2 / 1204)


def test_ranking_and_gauges(spark):
    view = spark.createDataFrame(
        [(1, False, 5), (2, True, 10), (3, False, 7), (4, True, 12)], "ad_id long, permanent boolean, marks long"
    )
    assert [r.ad_id for r in hot.hot_ranking(view).collect()] == [4, 2, 3, 1]
    assert tuple(hot.hot_gauges(view).first()) == (4, 2)


def test_rules_are_checked():
    with pytest.raises(ValueError):
        hot.HotRules(resolution=7)
    with pytest.raises(ValueError):
        hot.HotRules(stretch_buckets=5)
