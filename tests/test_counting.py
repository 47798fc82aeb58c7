import json

import pytest
from pyspark.sql import functions as F

from clickloom.operators import counting, filtering
from clickloom.sources.clicks import parse_clicks
from clickloom.sources.tables import read_counts, write_counts
from helpers import naive, plan_of, utc

NOW = utc(2026, 9, 26, 12, 34, 56)
MINUTE = "2026-09-26T12:30"


def click(ad, advertiser, salt, when, **more):
    return json.dumps(
        {
            "click_id": f"{ad}-{salt}-{when}",
            "ad_id": ad,
            "advertiser_id": advertiser,
            "salt": salt,
            "user_id": "u",
            "clicked_at": when,
            "receiver": "r",
            **more,
        }
    )


LINES = [
    *[click(1, 10, 0, f"{MINUTE}:0{n}.000Z") for n in range(3)],
    *[click(2, 10, salt, f"{MINUTE}:10.000Z") for salt in range(5)],
    click(2, 10, 7, "2026-09-26T12:31:00.000Z"),
    click(2, 10, 8, "2026-09-26T12:31:59.999Z"),
    click(3, 11, 0, "2026-09-26T10:30:00.000Z"),
    "{not json",
    '{"click_id":"x","ad_id":4,"advertiser_id":11,"user_id":"u","clicked_at":"2026-09-26T12:30:00.000Z"}',
]


def _kept(spark):
    frame = spark.createDataFrame([(line,) for line in LINES], "value string")
    return filtering.keep_click(parse_clicks(frame), NOW)


def _plain(frame):
    return sorted(
        (r.ad_id, r.advertiser_id, naive(r.minute).strftime("%H:%M"), r.click_count) for r in frame.collect()
    )


def test_salts_minutes_late_and_malformed(spark):
    wanted = [(1, 10, "12:30", 3), (2, 10, "12:30", 5), (2, 10, "12:31", 2)]
    kept = _kept(spark)
    assert _plain(counting.salted_minute_counts(kept, NOW)) == wanted
    assert _plain(counting.minute_counts(kept, NOW)) == wanted


def test_both_stages_combine_before_they_shuffle(spark):
    plan = counting.salted_minute_counts(_kept(spark), NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 4 and plan.count("Exchange") == 2
    plan = counting.minute_counts(_kept(spark), NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1


def _version(ad, count, run, batch):
    return (ad, 7, utc(2026, 1, 1), count, utc(2026, 1, 1, 0, 1), run, batch)


VERSIONS = (
    "ad_id long, advertiser_id long, minute timestamp, click_count long, updated_at timestamp, "
    "run_seq long, batch_id long"
)


def test_latest_version_wins_by_run_then_batch(spark):
    log = [_version(1, 5, 1, 9), _version(1, 6, 2, 0), _version(2, 3, 1, 4), _version(2, 4, 1, 5)]
    frame = spark.createDataFrame(log + log, VERSIONS)
    latest = counting.upsert_latest(frame)
    assert sorted((r.ad_id, r.click_count) for r in latest.collect()) == [(1, 6), (2, 4)]
    assert "SortAggregate" not in plan_of(latest)


def test_recount_repairs_only_what_it_touches(spark):
    current = spark.createDataFrame([_version(1, 5, 0, 0), _version(2, 3, 0, 0)], VERSIONS).drop(
        "run_seq", "batch_id"
    )
    recounted = current.where("ad_id = 1").withColumn("click_count", F.lit(8).cast("long"))
    fixed = counting.repair_counts(current, recounted)
    assert sorted((r.ad_id, r.click_count) for r in fixed.collect()) == [(1, 8), (2, 3)]


def test_counts_table_prunes_by_day_and_pushes_the_owner(spark, tmp_path):
    from clickloom.functions.spans import Span
    from clickloom.operators.series import in_span

    folder = str(tmp_path / "counts")
    minutes = spark.range(0, 4 * 1440, 60).select(
        (F.col("id") % 5).alias("ad_id"),
        (F.col("id") % 2).alias("advertiser_id"),
        F.timestamp_seconds(F.col("id") * 60 + 1_767_225_600).alias("minute"),
        F.lit(1).cast("long").alias("click_count"),
        F.lit(NOW).alias("updated_at"),
    )
    write_counts(minutes, folder, files_per_day=2)
    counts = read_counts(spark, folder)
    assert counts.count() == minutes.count()
    span = Span.covering("hour", utc(2026, 1, 2), utc(2026, 1, 3))
    mine = in_span(counts, span, 0)
    assert mine.count() == 24
    plan = plan_of(mine)
    assert "EqualTo(advertiser_id,0)" in plan and "GreaterThanOrEqual(minute" in plan
    assert "PartitionFilters: [isnotnull(day" in plan


def test_numbers_of_runs_that_cannot_be_ordered_raise(spark):
    from clickloom.operators.counting import upsert_latest

    row = (1, 10, NOW, 5, NOW, 1 << 23, 0)
    schema = (
        "ad_id long, advertiser_id long, minute timestamp, click_count long, updated_at timestamp,"
        " run_seq long, batch_id long"
    )
    with pytest.raises(Exception, match="too large"):
        upsert_latest(spark.createDataFrame([row], schema)).collect()
