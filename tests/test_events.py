"""Decoding, validating, filtering and encoding clicks."""

import json
from datetime import timedelta

from pyspark.sql import functions as F

from clickloom.operators import filtering
from clickloom.sources import clicks as source
from helpers import naive, utc

EVENT = {
    "click_id": "00c0ffee-0000-4000-8000-0000000000aa",
    "ad_id": 11,
    "advertiser_id": 3,
    "salt": 0,
    "user_id": "reader five",
    "clicked_at": "2031-03-04T05:06:07.089Z",
    "receiver": "edge-2",
}


def _records(spark, *values):
    texts = [v if isinstance(v, str) else json.dumps(v) for v in values]
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_lenient_decode(spark):
    offset = {**EVENT, "clicked_at": "2031-03-04T07:06:07.089+02:00"}
    missing = {k: v for k, v in EVENT.items() if k != "salt"}
    overflow = {**EVENT, "salt": 2**40}
    zoneless = {**EVENT, "clicked_at": "2031-03-04T05:06:07.089"}
    number = {**EVENT, "clicked_at": 1_790_000_000}
    got = source.parse_clicks(
        _records(spark, EVENT, "{not json", missing, offset, overflow, zoneless, number)
    ).collect()
    assert got[0].ad_id == 11 and naive(got[0].clicked_at).isoformat() == "2031-03-04T05:06:07.089000"
    assert all(value is None for value in got[1])
    assert got[2].salt is None and got[2].ad_id == 11
    assert got[3].clicked_at == got[0].clicked_at
    assert got[4].salt is None and got[4].user_id == EVENT["user_id"]
    assert got[5].clicked_at is None and got[6].clicked_at is None and got[6].ad_id == 11


def _broken(spark, *values):
    checked = filtering.validate_events(_records(spark, *values))
    return [row.broken_rules for row in checked.select("broken_rules").collect()]


def test_strict_validation(spark):
    def changed(**fields):
        return {**EVENT, **fields}

    cases = [
        (EVENT, []),
        (changed(salt=11), []),
        (changed(ad_id=42.0), []),
        (changed(salt=12), ["salt"]),
        (changed(salt=-1), ["salt"]),
        (changed(ad_id=0), ["ad_id"]),
        (changed(ad_id="42"), ["ad_id"]),
        (changed(ad_id=1.5), ["ad_id"]),
        (changed(ad_id=7.0000001), ["ad_id"]),
        (changed(user_id=""), ["user_id"]),
        (changed(user_id="x" * 129), ["user_id"]),
        (changed(user_id=5), ["user_id"]),
        (changed(click_id="abc"), ["click_id"]),
        (changed(clicked_at="2026-09-26 12:00:01"), ["clicked_at"]),
        (changed(clicked_at="2026-02-31T12:00:01Z"), ["clicked_at"]),
        (changed(extra=1), ["unknown_keys"]),
        (changed(receiver=None), ["receiver"]),
        ({k: v for k, v in EVENT.items() if k != "receiver"}, ["receiver"]),
        ("{not json", ["not_an_object"]),
        ("[1, 2]", ["not_an_object"]),
    ]
    assert _broken(spark, *[value for value, _ in cases]) == [rules for _, rules in cases]


def test_quarantine_split(spark):
    good, bad = filtering.split_valid(filtering.validate_events(_records(spark, EVENT, "{")))
    assert (good.count(), bad.count()) == (1, 1)


NOW = utc(2026, 9, 26, 12, 0, 0)


def _clicks(spark, rows):
    return spark.createDataFrame(
        rows, "ad_id long, advertiser_id long, salt int, clicked_at timestamp"
    )


def test_lateness_is_strict_and_future_clicks_stay(spark):
    ages = [
        (timedelta(seconds=5), "kept"),
        (timedelta(hours=1), "kept"),
        (timedelta(seconds=-2), "kept"),
        (timedelta(hours=1, milliseconds=1), "late"),
        (timedelta(hours=3), "late"),
    ]
    frame = _clicks(spark, [(1, 1, 0, NOW - age) for age, _ in ages])
    got = [r[0] for r in frame.select(filtering.disposition(NOW)).collect()]
    assert got == [label for _, label in ages]
    assert filtering.keep_click(frame, NOW).count() == 3


def test_any_missing_field_is_malformed_before_late(spark):
    late = NOW - timedelta(hours=5)
    frame = _clicks(spark, [(None, 1, 0, late), (1, None, 0, late), (1, 1, None, late), (1, 1, 0, None)])
    assert filtering.drop_counters(frame, NOW).first().asDict() == {
        "dropped_late": 0,
        "dropped_malformed": 4,
        "kept": 0,
    }


def test_keys_and_salts(spark):
    clicks = spark.range(3000).select(
        F.col("id").cast("string").alias("click_id"),
        F.lit(42).cast("long").alias("ad_id"),
        F.lit(7).cast("long").alias("advertiser_id"),
        F.lit("u").alias("user_id"),
        F.lit(NOW).alias("clicked_at"),
        F.lit("r").alias("receiver"),
        (F.col("id") % 2 == 0).alias("hot"),
    )
    salted = source.encode_events(source.assign_salt(clicks)).collect()
    salts = set()
    for row in salted:
        event = json.loads(row.value)
        assert list(event) == list(EVENT)
        if "#" in row.key:
            assert row.key == f"42#{event['salt']}" and 0 <= event["salt"] < 12
            salts.add(event["salt"])
        else:
            assert row.key == "42" and event["salt"] == 0
    assert salts == set(range(12))
    plain = source.encode_events(source.assign_salt(clicks, salting=False), salting=False)
    assert {(r.key, json.loads(r.value)["salt"]) for r in plain.collect()} == {("42", 0)}


def test_files_round_trip(spark, tmp_path):
    folder = str(tmp_path / "clicks")
    source.write_click_files(_records(spark, EVENT), folder)
    back = source.parse_clicks(source.read_click_files(spark, folder, streaming=False))
    assert back.first().click_id == EVENT["click_id"]
