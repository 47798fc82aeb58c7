import random
from datetime import timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from clickloom.operators import dedup
from helpers import plan_of, utc

T0 = utc(2026, 9, 26, 12)
SCHEMA = "click_id string, ad_id long, user_id string, attempted_at timestamp, dedup_ok boolean, produce string"


def follow(spark, attempts, ttl):
    """The rule, attempt by attempt."""
    ids = spark.createDataFrame([(a[0],) for a in attempts], "click_id string")
    tie = dict(ids.select("click_id", F.xxhash64("click_id")).collect())
    free, status = {}, {}
    for click_id, ad, user, at, ok, produce in sorted(attempts, key=lambda a: (a[3], tie[a[0]])):
        key, recorded = (ad, user), "accepted" if produce == "ack" else produce
        if ok and key in free and at < free[key]:
            status[click_id] = "duplicate"
            continue
        status[click_id] = recorded
        if ok and produce == "ack":
            free[key] = at + timedelta(seconds=ttl)
    return status


def outcomes(spark, attempts, ttl, chunk_ttls=dedup.CHUNK_TTLS):
    frame = spark.createDataFrame(attempts, SCHEMA)
    return {r.click_id: r.status for r in dedup.dedup_outcomes(frame, ttl, chunk_ttls).collect()}


def attempt(name, ad, user, seconds, ok=True, produce="ack"):
    return (name, ad, user, T0 + timedelta(seconds=seconds), ok, produce)


def test_repeat_on_the_same_ad_only(spark):
    got = outcomes(
        spark,
        [attempt("a", 42, "u1", 0), attempt("b", 42, "u1", 5), attempt("c", 42, "u2", 6), attempt("d", 43, "u1", 7)],
        600,
    )
    assert got == {"a": "accepted", "b": "duplicate", "c": "accepted", "d": "accepted"}


def test_window_runs_from_the_accepted_click(spark):
    got = outcomes(spark, [attempt(str(s), 1, "u", s) for s in (0, 400, 599, 600, 1199, 1200)], 600)
    assert [got[str(s)] for s in (0, 400, 599, 600, 1199, 1200)] == [
        "accepted", "duplicate", "duplicate", "accepted", "duplicate", "accepted",
    ]


def test_fail_open_counts_and_claims_nothing(spark):
    got = outcomes(
        spark, [attempt("a", 1, "u", 0, ok=False), attempt("b", 1, "u", 1, ok=False), attempt("c", 1, "u", 2)], 600
    )
    assert set(got.values()) == {"accepted"}


@pytest.mark.parametrize("failure", ["rejected", "ambiguous", "shed"])
def test_a_failed_attempt_gives_its_claim_back(spark, failure):
    got = outcomes(
        spark,
        [attempt("a", 1, "u", 0, produce=failure), attempt("b", 1, "u", 1), attempt("c", 1, "u", 2, produce=failure)],
        600,
    )
    assert got == {"a": failure, "b": "accepted", "c": "duplicate"}


def test_one_of_an_instant_is_accepted(spark):
    attempts = [attempt(name, 1, "u", 0) for name in "abcdef"]
    attempts += [attempt(name, 1, "u", 0, produce="rejected") for name in "ghijkl"]
    got = outcomes(spark, attempts, 600)
    assert list(got.values()).count("accepted") == 1 and got == follow(spark, attempts, 600)


def _random_attempts(seed, size, span, step):
    pick = random.Random(seed)
    return [
        attempt(
            f"{number:06d}",
            1 if pick.random() < 0.5 else pick.randint(2, 4),
            "bot" if pick.random() < 0.5 else f"u{pick.randint(0, 3)}",
            pick.randrange(0, span, step),
            ok=pick.random() > 0.05,
            produce=pick.choices(["ack", "rejected", "shed", "ambiguous"], [90, 4, 3, 3])[0],
        )
        for number in range(size)
    ]


@pytest.mark.parametrize("seed, span, step, ttl, chunk", [
    (1, 20_000, 1, 600, 8),
    (2, 20_000, 7, 600, 2),
    (3, 3_000, 1, 100, 3),
    (4, 100_000, 50, 600, 2),
    (5, 2_000, 1, 7, 2),
])
def test_random_attempts_follow_the_rule(spark, seed, span, step, ttl, chunk):
    attempts = _random_attempts(seed, 3_000, span, step)
    assert outcomes(spark, attempts, ttl, chunk) == follow(spark, attempts, ttl)


def test_a_metronome_crosses_every_chunk(spark):
    """One key, a click each 7 s for days: chains of different phase never meet."""
    attempts = [attempt(f"{n:06d}", 1, "bot", n * 7) for n in range(20_000)]
    assert outcomes(spark, attempts, 600, 4) == follow(spark, attempts, 600)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.integers(0, 400), min_size=1, max_size=60, unique=True).map(sorted),
    st.integers(1, 40),
)
def test_chunk_function_equals_following_the_chain(offsets, ttl):
    start = 1_000
    times = np.array(offsets) + start
    entries, exits = dedup.chunk_function(times, start, ttl)
    for free_at in range(start, start + ttl):
        expected = free_at
        for t in times:
            if t >= expected:
                expected = t + ttl
        place = np.searchsorted(entries, free_at)
        assert (exits[place] if place < len(exits) else free_at) == expected


def test_linked_chunks_are_followed_over_batches():
    import pandas as pd

    chunks = pd.DataFrame(
        {
            "ad_id": [1, 1, 1, 2],
            "user_id": ["u"] * 4,
            "chunk": [4, 5, 6, 9],
            "seed": [40.0, None, None, 95.0],
            "entries": [np.array([42, 46]), np.array([50, 58]), np.array([61]), np.array([91])],
            "exits": [np.array([55, 57]), np.array([63, 68]), np.array([72]), np.array([99])],
        }
    )
    told = pd.concat(dedup._follow(iter([chunks.iloc[:2], chunks.iloc[2:]])))
    # free at 40 -> enters 42 -> 55 -> enters 58 -> 68 -> past 61, still 68; the other key past 91
    assert list(told["entry"]) == [55, 68, 68, 95]
    assert list(told["chunk"]) == [5, 6, 7, 10]


def test_the_hot_key_is_split_and_its_shuffles_are_shared(spark, sf_dir):
    from clickloom.plans import inputs

    attempts = inputs.attempts(spark, sf_dir, "hot_key")
    sizes = dedup._chunks(attempts, 600_000_000, 4_800_000_000)
    assert sizes.agg(F.max(F.size("instants"))).first()[0] < 20
    result = dedup.dedup_outcomes(attempts, 86_400)
    result.collect()
    plan = plan_of(result)
    plan = plan[: plan.index("Initial Plan")]
    # one shuffle of the instants and one of the chunks, whatever uses them
    assert plan.count("ReusedExchange") >= 3
    assert plan.count("Scan parquet") == 2
    assert "BatchEvalPython" not in plan


def test_every_attempt_has_one_outcome(spark, sf_dir):
    from clickloom.plans import inputs

    attempts, ads = inputs.attempts(spark, sf_dir), inputs.ads(spark, sf_dir)
    classified = dedup.classify_attempts(attempts, ads, 86_400).withColumn("hot", F.lit(False))
    counts = {r.status: r.attempts for r in dedup.outcome_counts(classified).collect()}
    assert sum(counts.values()) == attempts.count()
    assert set(counts) <= {"accepted", "duplicate", "shed", "rejected", "ambiguous", "not_found"}


def test_invalid_settings():
    with pytest.raises(ValueError):
        dedup.accepted_claims(None, 0)
    with pytest.raises(ValueError):
        dedup.accepted_claims(None, 600, 1)
