import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import measurement, percentiles
from clickloom.sources import samples as source
from helpers import plan_of, utc


def nearest(values, p):
    values = sorted(values)
    return values[min(len(values) - 1, max(0, round(p / 100 * (len(values) - 1))))]


def test_percentiles_of_skewed_groups(spark):
    pick = random.Random(3)
    rows = []
    for _ in range(6000):
        group = "big" if pick.random() < 0.5 else f"g{pick.randint(0, 40)}"
        value = pick.choice([0.0, -1.5, pick.gauss(0, 1), pick.expovariate(0.01), 7.0])
        rows.append((group, value))
    rows += [("one", 4.0), ("empty", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    wanted = {"p0": 0, "p50": 50, "p95": 95, "p99": 99, "p100": 100}
    got = {r.g: r for r in percentiles.percentiles(frame, ["g"], "v", wanted).collect()}
    by_group = {}
    for group, value in rows:
        if value is not None:
            by_group.setdefault(group, []).append(value)
    assert set(got) == set(by_group)
    for group, values in by_group.items():
        assert got[group].n == len(values) and got[group]["max"] == max(values)
        for name, p in wanted.items():
            assert got[group][name] == nearest(values, p), (group, name)


def test_interpolated_percentile(spark):
    pick = random.Random(4)
    rows = [(pick.randint(0, 3), pick.gauss(50, 20)) for _ in range(500)]
    frame = spark.createDataFrame(rows, "g int, v double")
    exact = {r.g: r.p for r in frame.groupBy("g").agg(F.percentile("v", 0.95).alias("p")).collect()}
    for row in percentiles.interpolated_percentile(frame, ["g"], "v", 95, "p").collect():
        assert row.p == pytest.approx(exact[row.g], rel=1e-12)


def test_bins_follow_the_values(spark):
    values = sorted(random.Random(5).uniform(-1e6, 1e6) for _ in range(500)) + [0.0, 1e-300, -1e-300, 5e-324]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    bins = frame.orderBy("v").select(percentiles.value_bin(F.col("v")).alias("b")).collect()
    assert [r.b for r in bins] == sorted(r.b for r in bins)


def test_half_ranks_round_to_even(spark):
    # 50 % of 5 - 1 and of 2 - 1: ranks 2 and 0.5 -> 0
    frame = spark.createDataFrame([(n, float(v)) for n in (2, 4, 5) for v in range(n)], "g int, v double")
    got = {r.g: r.p for r in percentiles.percentiles(frame, ["g"], "v", {"p": 50}).collect()}
    assert got == {2: 0.0, 4: 2.0, 5: 2.0}


LOG = """metric_name,timestamp,metric_value,name,status
http_req_duration,1000.9,10,GET /click/{ad_id},302
http_req_duration,1009,30,GET /click/{ad_id},302
http_req_duration,1011,120,GET /click/{ad_id},302
http_req_duration,1035,5,GET /click/{ad_id},503
http_req_duration,1036,6,GET /click/{ad_id},302
http_req_duration,1041,7,GET /click/{ad_id},302
http_req_duration,1041,7,POST ad,500
http_reqs,1041,1,GET /click/{ad_id},302
"""


@pytest.mark.parametrize("packed", [False, True])
def test_timeline_from_a_sample_log(spark, tmp_path, packed):
    import gzip

    path = tmp_path / ("log.csv.gz" if packed else "log.csv")
    path.write_bytes(gzip.compress(LOG.encode()) if packed else LOG.encode())
    samples = source.request_samples(source.read_sample_log(spark, str(path)))
    timeline = measurement.latency_timeline(samples, 10)
    got = [
        (r.bucket, r.requests, r.errors, r.p50, r.p95, r["max"], r.by_status)
        for r in timeline.orderBy("bucket").collect()
    ]
    assert got == [
        (1000, 2, 0, 10.0, 30.0, 30.0, {"302": 2}),
        (1010, 1, 0, 120.0, 120.0, 120.0, {"302": 1}),
        (1030, 2, 1, 5.0, 6.0, 6.0, {"302": 1, "503": 1}),
        (1040, 1, 0, 7.0, 7.0, 7.0, {"302": 1}),
    ]
    window = measurement.degraded_window(timeline, 10).first()
    assert tuple(window) == (1010, 1030, 2, 30)
    healthy = measurement.degraded_window(timeline.where("bucket = 1000"), 10).first()
    assert tuple(healthy) == (None, None, 0, None)


def test_timeline_never_gathers_a_bucket(spark):
    frame = spark.range(10).select(
        F.col("id").alias("timestamp"), F.lit("302").alias("status"), F.col("id").cast("double").alias("metric_value")
    )
    plan = plan_of(measurement.latency_timeline(frame))
    assert "collect_list(metric_value" not in plan and "percentile" not in plan


def _samples(spark, rows):
    return spark.createDataFrame(
        rows, "kind string, scenario string, runner string, status string, metric_value double"
    )


def _gates(frame):
    return {r.gate: (r.value, r["pass"]) for r in frame.collect()}


def test_gates_of_a_good_and_a_bad_run(spark):
    good = [("click", s, r, "302", 20.0) for s in ("clicks", "clicks_burst") for r in "ab" for _ in range(600)]
    good += [("query", "queries", "a", "200", 30.0)]
    verdict = _gates(measurement.run_gates(_samples(spark, good), "clicks"))
    assert all(passed for _, passed in verdict.values()) and len(verdict) == 5
    bad = good + [("click", "clicks", "c", "503", 150.0) for _ in range(30)]
    verdict = _gates(measurement.run_gates(_samples(spark, bad), "clicks"))
    assert verdict["click p95 steady ms"] == (150.0, False)
    assert verdict["click error rate %"] == (round(30 / 2430 * 100, 4), False)
    assert verdict["click p95 burst ms"] == (20.0, True)


def test_a_missing_value_fails_and_a_report_has_no_verdict(spark):
    none = _samples(spark, [("query", "queries", "a", "200", 1.0)])
    verdict = _gates(measurement.run_gates(none, "hot"))
    assert verdict["click p95 steady ms"] == (None, False)
    assert verdict["click error rate %"] == (0.0, True)
    assert verdict["hot ad seen at s"] == (None, False)
    assert verdict["partition skew max/min"] == (None, None)
    assert _gates(measurement.run_gates(none, "scale")) == {
        "click p95 ms": (None, None),
        "click error rate %": (0.0, None),
    }


def test_worst_runner_beside_the_merged_percentile(spark):
    rows = [("click", "clicks", "a", "302", float(v)) for v in range(100)]
    rows += [("click", "clicks", "b", "302", 500.0)]
    got = measurement.runner_p95(_samples(spark, rows)).first()
    assert (got.runners, got.max_runner_p95, got.merged_p95) == (2, 500.0, nearest([r[4] for r in rows], 95))


def _verdict(spark, expected, counted, ambiguous):
    e = spark.createDataFrame(expected, "advertiser_id long, accepted long")
    c = spark.createDataFrame(counted, "advertiser_id long, click_count long")
    row = measurement.reconcile_verdict(measurement.reconcile(e, c), ambiguous).first()
    return row.lost, row.over, row["pass"]


def test_reconcile(spark):
    assert _verdict(spark, [(1, 7), (2, 3)], [(1, 4), (1, 3), (2, 3), (9, 50)], 0) == (0, 0, True)
    assert _verdict(spark, [(1, 7), (2, 3)], [(1, 7)], 5) == (3, 0, False)
    assert _verdict(spark, [(1, 7)], [(1, 9)], 2) == (0, 2, True)
    assert _verdict(spark, [(1, 7)], [(1, 9)], 1) == (0, 2, False)


def test_expected_from_labelled_series(spark):
    rows = [
        ("acc", {"advertiser": "1", "testid": "x"}, utc(2026, 1, 1), 3.0),
        ("acc", {"advertiser": "1", "testid": "x"}, utc(2026, 1, 2), 4.0),
        ("acc", {"advertiser": "1", "testid": "y"}, utc(2026, 1, 3), 9.0),
        ("other", {"advertiser": "1", "testid": "x"}, utc(2026, 1, 4), 9.0),
    ]
    series = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double")
    run = source.select_series(series, "acc", testid="x")
    assert [tuple(r) for r in measurement.expected_from_series(run).collect()] == [(1, 7)]
    assert measurement.last_sample(run).first()[0].day == 2


def test_partition_skew(spark):
    rates = spark.createDataFrame([(0, 10), (1, 40), (2, 20)], "partition int, records long")
    assert tuple(measurement.partition_skew(rates).first()) == (3, 40, 10, 4.0)


def test_longest_pause_across_hours_and_years(spark):
    times = [utc(2020, 1, 1), utc(2020, 1, 1, 0, 10), utc(2020, 1, 1, 5), utc(2023, 6, 1), utc(2023, 6, 2)]
    frame = spark.createDataFrame([(t,) for t in times for _ in range(3)], "updated_at timestamp")
    got = measurement.longest_pause(frame).first()[0]
    assert got == (times[3] - times[2]).total_seconds()
    assert measurement.longest_pause(frame.limit(0)).first()[0] is None


def test_nothing_expected_fails(spark):
    none = spark.createDataFrame([], "advertiser_id long, accepted long, counted long, diff long")
    assert measurement.reconcile_verdict(none, 5).first()["pass"] is False


def test_labels_that_are_no_number_are_left_out(spark):
    rows = [({"advertiser": "7"}, 2.0), ({"advertiser": "seven"}, 3.0), ({}, 1.0)]
    series = spark.createDataFrame(rows, "labels map<string,string>, value double")
    assert [tuple(r) for r in measurement.expected_from_series(series).collect()] == [(7, 2)]


def test_idle_partitions_count(spark):
    rates = measurement.partition_rates(spark.createDataFrame([("k",)] * 3, "key string"), 4)
    assert sorted(r.records for r in rates.collect()) == [0, 0, 0, 3]
    assert measurement.partition_skew(rates).first()["skew"] == 3 / 1e-9


def test_infinity_and_not_a_number_are_ranked_last(spark):
    from clickloom.operators.percentiles import percentiles

    inf, nan = float("inf"), float("nan")
    rows = [(1, v) for v in (3.0, inf, 1.0, -inf, nan, 2.0)] + [(2, inf), (2, 5.0)]
    frame = spark.createDataFrame(rows, "k int, v double")
    found = {r.k: r for r in percentiles(frame, ["k"], "v", {"low": 0, "p40": 40, "p80": 80, "top": 100}).collect()}
    assert (found[1].low, found[1].p40, found[1].p80) == (-inf, 2.0, inf)
    assert found[1].top != found[1].top and found[1]["max"] != found[1]["max"]
    assert (found[2].low, found[2].top) == (5.0, inf)


def test_a_bin_that_holds_most_values_is_divided(spark):
    """Nine tenths of the values within one part in a thousand of each other: one bin, at first."""
    pick = random.Random(12)
    rows = [("g", 1000.0 + pick.random()) for _ in range(20_000)]
    rows += [("g", pick.expovariate(0.001)) for _ in range(2_000)]
    frame = spark.createDataFrame(rows, "g string, v double")
    values = [v for _, v in rows]
    wanted = {"p5": 5, "p50": 50, "p90": 90}
    for rounds in (0, 1, 3):
        ranks = {name: percentiles.nearest_rank(p) for name, p in wanted.items()}
        row = percentiles.values_at_ranks(frame, ["g"], "v", ranks, rounds=rounds).first()
        assert [row[name] for name in wanted] == [nearest(values, p) for p in wanted.values()]
    counted = frame.groupBy("g", percentiles.value_bin(F.col("v")).alias("bin"), F.col("v").alias("value")).agg(
        F.count("*").alias("times")
    )
    heavy = counted.groupBy("g", "bin").agg(
        F.count("*").alias("held"), F.min("value").alias("low"), F.max("value").alias("high")
    ).orderBy(F.desc("held")).limit(1)
    held = heavy.first().held
    assert held > 15_000
    target = heavy.selectExpr(
        "g", "bin", "'m' AS name", "0L AS n", "0D AS top", "low", "high", "held div 2 AS offset"
    )
    # What is left to be put in order after one round is a share of it, set by the width alone.
    left = percentiles._inside(counted, percentiles._narrowed(counted, target, ["g"]), ["g"])
    assert 0 < left.count() < held / 100


def test_a_run_is_judged_by_its_own_series(spark):
    def at(hour, minute):
        return utc(2031, 5, 6, hour, minute)

    def sample(metric, run, value, when, advertiser="7"):
        return (metric, {"advertiser": advertiser, "testid": run}, when, float(value))

    schema = "metric string, labels map<string,string>, ts timestamp, value double"
    series = [
        sample("clicks_accepted_adv", "a", 90, at(11, 50)),
        sample("clicks_accepted_adv", "a", 10, at(11, 40), "8"),
        sample("clicks_503", "a", 2, at(11, 50)),
        sample("clicks_other", "a", 1, at(11, 50)),
        sample("clicks_accepted_adv", "b", 5, at(15, 0)),
    ]
    counts = [
        (1, 7, at(10, 59), 1000, at(11, 0)),
        (1, 7, at(11, 0), 50, at(11, 1)),
        (2, 7, at(11, 59), 43, at(12, 0)),
        (3, 8, at(11, 30), 10, at(11, 31)),
    ]
    frame = spark.createDataFrame(series, schema)
    counted = spark.createDataFrame(
        counts, "ad_id long, advertiser_id long, minute timestamp, click_count long, updated_at timestamp"
    )
    row = measurement.reconcile_run(frame, counted, "a").first()
    assert (row.lost, row.over, row.mismatched, row.ambiguous, row["pass"]) == (0, 3, 1, 3, True)
    late = measurement.reconcile_run(frame, counted.where("ad_id <> 3"), "a").first()
    assert (late.lost, late["pass"]) == (10, False)
    none = measurement.reconcile_run(frame, counted, "absent").first()
    assert none["pass"] is False
