"""The streaming jobs: restart, replay, late and future clicks, and agreement with batch."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from clickloom.operators import counting, dedup, hot
from clickloom.sources.clicks import parse_clicks, read_click_files
from clickloom.streaming import counts, sinks, stateful
from helpers import naive, utc
from test_counting import LINES, NOW, click
from test_dedup import follow


def write_lines(folder, name, lines):
    """One file, put in place whole."""
    os.makedirs(folder, exist_ok=True)
    hidden = os.path.join(folder, f".{name}")
    with open(hidden, "w") as file:
        file.write("\n".join(lines) + "\n")
    os.rename(hidden, os.path.join(folder, name))


class Job:
    def __init__(self, spark, root, as_of=NOW, **config):
        self.spark, self.as_of = spark, as_of
        self.source, self.log, self.checkpoint = (str(root / n) for n in ("in", "log", "ck"))
        self.config = counts.CountingConfig(**config)

    def run(self, run_seq=1, checkpoint=None):
        clicks = parse_clicks(read_click_files(self.spark, self.source, max_files_per_trigger=1))
        query = counts.start_counting(
            clicks,
            self.log,
            checkpoint or self.checkpoint,
            run_seq,
            self.config,
            as_of=F.lit(self.as_of),
            available_now=True,
        )
        query.awaitTermination()
        return query

    def current(self):
        found = counts.current_counts(counts.read_versions(self.spark, self.log)).collect()
        return sorted(
            (r.ad_id, r.advertiser_id, naive(r.minute).strftime("%H:%M"), r.click_count) for r in found
        )


WANTED = [(1, 10, "12:30", 3), (2, 10, "12:30", 5), (2, 10, "12:31", 2)]


def test_counts_restart_replay_and_counters(spark, tmp_path):
    job = Job(spark, tmp_path)
    write_lines(job.source, "a", LINES[:6])
    job.run()
    write_lines(job.source, "b", LINES[6:])
    # a new query on the old checkpoint goes on where the first stopped
    query = job.run()
    assert job.current() == WANTED
    drops = [p.observedMetrics[counts.DROP_COUNTERS] for p in query.recentProgress if p.numInputRows]
    assert (sum(d.dropped_late for d in drops), sum(d.dropped_malformed for d in drops)) == (1, 2)
    # the last batch again, as after a crash before its commit
    commits = os.path.join(job.checkpoint, "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in os.listdir(commits):
        if name in (str(last), f".{last}.crc"):
            os.remove(os.path.join(commits, name))
    job.run()
    assert job.current() == WANTED
    # everything again from the start under a new run
    job.run(run_seq=2, checkpoint=str(tmp_path / "ck2"))
    assert job.current() == WANTED


def test_a_future_click_is_counted_and_harms_no_other(spark, tmp_path):
    job = Job(spark, tmp_path)
    write_lines(job.source, "a", [click(1, 10, 0, "2026-09-26T22:00:00.000Z")])
    job.run()
    write_lines(job.source, "b", [click(1, 10, 0, "2026-09-26T12:30:00.000Z")])
    job.run()
    job.as_of = NOW + timedelta(minutes=1)
    write_lines(job.source, "c", [click(1, 10, 1, "2026-09-26T22:00:30.000Z")])
    job.run()
    assert job.current() == [(1, 10, "12:30", 1), (1, 10, "22:00", 2)]


def test_a_later_run_replaces_every_part_of_a_minute(spark, tmp_path):
    job = Job(spark, tmp_path)
    write_lines(job.source, "a", [click(1, 10, 0, "2026-09-26T22:00:00.000Z")])
    job.run()
    job.as_of = NOW + timedelta(minutes=5)
    job.run(run_seq=2, checkpoint=str(tmp_path / "ck2"))
    assert job.current() == [(1, 10, "22:00", 1)]


def test_a_new_checkpoint_on_a_used_run_is_refused(spark, tmp_path):
    job = Job(spark, tmp_path)
    write_lines(job.source, "a", LINES)
    job.run()
    with pytest.raises(ValueError, match="run_seq 1"):
        job.run(checkpoint=str(tmp_path / "lost"))
    assert job.current() == WANTED


def test_recount_repairs_what_the_stream_dropped(spark, tmp_path):
    job = Job(spark, tmp_path)
    write_lines(job.source, "a", LINES)
    job.run()
    raw = parse_clicks(read_click_files(spark, job.source, streaming=False))
    counts.publish_recount(counting.recount(raw).drop("updated_at"), job.log, run_seq=2)
    assert job.current() == sorted([*WANTED, (3, 11, "10:30", 1)])
    compacted = str(tmp_path / "compact")
    counts.compact(spark, job.log, compacted, files=2)
    before = job.current()
    job.log = compacted
    assert job.current() == before


def test_state_must_outlive_the_cutoff():
    with pytest.raises(ValueError):
        counts.CountingConfig(cutoff_ms=3_600_000, state_ttl_ms=3_600_000)


def test_one_aggregate_with_a_map_side_half(spark, tmp_path):
    job = Job(spark, tmp_path)
    write_lines(job.source, "a", LINES)
    query = job.run()
    plan = query._jsq.explainInternal(False)
    plan = plan[plan.index("Physical Plan") :]
    assert plan.count("StateStoreSave") == 1 and plan.count("Exchange hashpartitioning") <= 2
    assert plan.count("partial_count(1)") >= 1


def _rows(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


ATTEMPT = (
    "click_id string, ad_id long, user_id string, attempted_at timestamp, dedup_ok boolean, produce string"
)


def test_stream_dedup_follows_the_rule_over_restarts(spark, tmp_path):
    pick = random.Random(8)
    start = utc(2026, 9, 26)
    attempts = [
        (
            f"{n:04d}",
            pick.randint(1, 2),
            pick.choice(["bot", "bot", "u1", "u2"]),
            start + timedelta(seconds=n * 20 + pick.randint(0, 19)),
            pick.random() > 0.1,
            pick.choices(["ack", "rejected", "shed"], [8, 1, 1])[0],
        )
        for n in range(300)
    ]
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "ck"))
    for part in (attempts[:100], attempts[100:180], attempts[180:]):
        _rows(spark, source, part, ATTEMPT)
        stream = spark.readStream.schema(ATTEMPT).parquet(source)
        sinks.start_log(
            stateful.stream_dedup(stream, 600, 86_400), log, checkpoint, "append", available_now=True
        ).awaitTermination()
    got = {r.click_id: r.status for r in spark.read.parquet(log).collect()}
    assert got == follow(spark, attempts, 600)
    batch = dedup.dedup_outcomes(spark.createDataFrame(attempts, ATTEMPT), 600)
    assert got == {r.click_id: r.status for r in batch.collect()}


def _labelled(spark, tmp_path, *parts):
    """Statuses of one key's attempts, given as seconds, over micro-batches."""
    now = datetime.now(timezone.utc).replace(microsecond=0)
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "ck"))
    number, names = 0, {}
    for part in parts:
        rows = []
        for second in part:
            names[f"{number}"] = second
            rows.append((f"{number}", 1, "u", now + timedelta(seconds=second), True, "ack"))
            number += 1
        _rows(spark, source, rows, ATTEMPT)
        stream = spark.readStream.schema(ATTEMPT).parquet(source)
        sinks.start_log(
            stateful.stream_dedup(stream, 600, 7200), log, checkpoint, "append", available_now=True
        ).awaitTermination()
    found = spark.read.parquet(log).collect()
    return {names[r.click_id]: r.status for r in found}


def test_a_click_dated_ahead_hides_no_claim(spark, tmp_path):
    got = _labelled(spark, tmp_path, [86_400], [-3000], [-2990], [-2980, -2400], [86_410])
    assert got == {
        86_400: "accepted",
        -3000: "accepted",
        -2990: "duplicate",
        -2980: "duplicate",
        -2400: "accepted",
        86_410: "duplicate",
    }


def test_a_late_click_claims_for_its_own_time(spark, tmp_path):
    got = _labelled(spark, tmp_path, [-1000], [-1700], [-1690], [-990])
    assert got == {-1000: "accepted", -1700: "accepted", -1690: "duplicate", -990: "duplicate"}


def test_a_click_dated_ahead_leaves_hot_buckets_alone(spark, tmp_path):
    rules = hot.HotRules(threshold=240)
    now = int(datetime.now(timezone.utc).timestamp()) - 300
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "ck"))
    schema = "ad_id long, clicked_at timestamp"
    parts = [[now + 86_400], [now] * 200, [now + 61] * 40]
    for part in parts:
        rows = [(1, datetime.fromtimestamp(t, timezone.utc)) for t in part]
        _rows(spark, source, rows, schema)
        stream = spark.readStream.schema(schema).parquet(source)
        sinks.start_log(
            stateful.stream_hot(stream, rules), log, checkpoint, "update", available_now=True
        ).awaitTermination()
    found = stateful.latest_markings(spark.read.parquet(log), rules).collect()
    assert [(r.ad_id, r.mark_no) for r in found] == [(1, 1)]


def test_stream_hot_equals_batch(spark, tmp_path):
    pick = random.Random(9)
    rules = hot.HotRules(threshold=24, permanent_after=3)
    start = int(utc(2026, 9, 26).timestamp())
    seconds = sorted(pick.randrange(0, 30_000) for _ in range(1500))
    rows = [(pick.choice([1, 1, 2]), datetime.fromtimestamp(start + s, timezone.utc)) for s in seconds]
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "ck"))
    schema = "ad_id long, clicked_at timestamp"
    for part in (rows[:400], rows[400:401], rows[401:]):
        _rows(spark, source, part, schema)
        stream = spark.readStream.schema(schema).parquet(source)
        sinks.start_log(
            stateful.stream_hot(stream, rules), log, checkpoint, "update", available_now=True
        ).awaitTermination()
    got = stateful.latest_markings(spark.read.parquet(log), rules)
    wanted = hot.hot_intervals(spark.createDataFrame(rows, schema), rules)
    assert wanted.count() > 3
    assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0


def test_exact_copies_go(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "ck"))
    line = json.loads(LINES[0])
    write_lines(source, "a", [json.dumps(line), json.dumps(line), json.dumps({**line, "click_id": "other"})])
    clicks = parse_clicks(read_click_files(spark, source))
    sinks.start_log(stateful.drop_exact_copies(clicks), log, checkpoint, "append", available_now=True).awaitTermination()
    assert spark.read.parquet(log).count() == 2


def test_progress_is_reported(spark, tmp_path):
    from clickloom.streaming.progress import ProgressListener, progress_row, recent_progress

    told = []
    listener = ProgressListener(told.append)
    spark.streams.addListener(listener)
    try:
        job = Job(spark, tmp_path)
        write_lines(job.source, "a", LINES)
        query = job.run()
        rows = recent_progress(spark, query).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert sum(r.input_rows for r in rows) == len(LINES)
    assert max(r.state_rows for r in rows) >= 3 and {r.records_behind for r in rows} == {None}
    assert sum(t["input_rows"] for t in told) == len(LINES)
    topic = {"id": "q", "batchId": 1, "timestamp": "t", "numInputRows": 2, "sources": [
        {"metrics": {"maxOffsetsBehindLatest": "17"}}, {"metrics": {"maxOffsetsBehindLatest": "3.0"}}]}
    assert progress_row(topic)[-1] == 17


# -- disordered input, the whole path, and the log of commits ---------------------------------

LATE_ATTEMPT = ATTEMPT + ", arrived_at timestamp"


def _stepped(spark, source, schema, parts, start):
    """The job over each part in turn; the progress of every batch."""
    progress = []
    for part in parts:
        _rows(spark, source, part, schema)
        job = start(spark.readStream.schema(schema).parquet(source))
        job.awaitTermination()
        progress += job.recentProgress
    return progress


def _shuffled(pick, rows, seconds):
    """Rows ``(time, ...)`` by an arrival up to so late; one in ten comes a day before its time."""
    late = [
        (*row, row[3] + timedelta(seconds=-86_400 if pick.random() < 0.1 else pick.randrange(seconds)))
        for row in rows
    ]
    return sorted(late, key=lambda row: row[-1])


def test_disordered_attempts_get_the_labels_of_the_batch(spark, tmp_path):
    pick = random.Random(21)
    start = utc(2026, 9, 26)
    attempts = [
        (
            f"{n:04d}",
            pick.randint(1, 2),
            pick.choice(["bot", "bot", "u1"]),
            start + timedelta(seconds=pick.randrange(8000)),
            pick.random() > 0.1,
            pick.choices(["ack", "rejected", "shed"], [8, 1, 1])[0],
        )
        for n in range(300)
    ]
    rows = _shuffled(pick, attempts, 900)
    tick = (None, None, None, None, None, None, start + timedelta(days=3))
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "ck"))

    def job(stream):
        labelled = stateful.stream_dedup(
            stream, 600, 1200, delay="900 seconds", clock="arrived_at", in_order=True
        )
        return sinks.start_log(labelled, log, checkpoint, "append", available_now=True)

    progress = _stepped(spark, source, LATE_ATTEMPT, (rows[:90], rows[90:200], [*rows[200:], tick]), job)
    got = {r.click_id: r.status for r in spark.read.parquet(log).collect()}
    assert got == follow(spark, attempts, 600)
    assert "duplicate" in got.values()
    # Nothing is kept once the watermark is past the last claim.
    state = [p.stateOperators[0].numRowsTotal for p in progress]
    assert max(state) > 5 and state[-1] == 0


def test_an_attempt_after_its_answer_is_still_answered(spark, tmp_path):
    start = utc(2026, 9, 26)

    def row(name, second, arrives):
        moments = (start + timedelta(seconds=s) for s in (second, arrives))
        t, arrived = moments
        return (name, 1, "u", t, True, "ack", arrived)

    parts = [
        [row("a", 1000, 1000), row("later", 5000, 5000)],
        [row("near", 990, 5000), row("free", 100, 5000), row("end", 9000, 9000)],
        [(None,) * 6 + (start + timedelta(days=1),)],
    ]
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "ck"))

    def job(stream):
        labelled = stateful.stream_dedup(stream, 600, 7200, clock="arrived_at", in_order=True)
        return sinks.start_log(labelled, log, checkpoint, "append", available_now=True)

    _stepped(spark, source, LATE_ATTEMPT, parts, job)
    got = {r.click_id: r.status for r in spark.read.parquet(log).collect()}
    assert got == {
        "a": "accepted",
        "later": "accepted",
        "near": "duplicate",
        "free": "accepted",
        "end": "accepted",
    }


def test_buckets_of_idle_ads_leave_the_state(spark, tmp_path):
    rules = hot.HotRules(threshold=5)
    start = utc(2026, 9, 26)
    schema = "ad_id long, clicked_at timestamp, arrived_at timestamp"
    clicks = [(ad, start + timedelta(seconds=7 * n + ad)) for ad in range(1, 4) for n in range(4)]
    clicks += [(9, start + timedelta(seconds=n)) for n in range(6)]
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "ck"))

    def job(stream):
        changes = stateful.stream_hot(stream, rules, clock="arrived_at", in_order=True)
        return sinks.start_log(changes, log, checkpoint, "append", available_now=True)

    parts = [[(*c, c[1]) for c in clicks], [(None, None, start + timedelta(hours=2))]]
    progress = _stepped(spark, source, schema, parts, job)
    state = [p.stateOperators[0].numRowsTotal for p in progress]
    # Only the number of marks of the ad that was hot stays.
    assert max(state) > 5 and state[-1] == 1
    found = stateful.latest_markings(spark.read.parquet(log), rules).collect()
    assert [(r.ad_id, r.mark_no) for r in found] == [(9, 1)]


def _accepted(spark, tmp_path, parts, ads, changes=None):
    from clickloom.streaming import accept
    from clickloom.streaming.log import VersionedLog

    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "log", "ck"))
    feed = str(tmp_path / "ads")
    ad = "id long, advertiser_id long, redirect_url string, active boolean"
    if changes:
        _rows(spark, feed, changes, ad + ", changed_at timestamp")

    def job(stream):
        versions = None
        if changes:
            versions = spark.readStream.schema(ad + ", changed_at timestamp").parquet(feed)
        outcomes = accept.stream_outcomes(
            stream, spark.createDataFrame(ads, ad), versions, delay="0 seconds", clock="arrived_at"
        )
        return accept.start_accepting(outcomes, path, checkpoint, available_now=True)

    progress = _stepped(spark, source, LATE_ATTEMPT, parts, job)
    return VersionedLog(spark, path), checkpoint, job, source, progress


OUTCOME = "click_id string, ad_id long, advertiser_id long, status string, hot boolean"
REJECT = "click_id string, broken_rules array<string>"


def test_the_catalogue_at_the_time_of_the_click(spark, tmp_path):
    start = utc(2026, 9, 26)

    def at(second):
        return start + timedelta(seconds=second)

    attempts = [
        (f"{ad}-{s}", ad, f"u{s}", at(s), True, "ack", at(s)) for ad in (1, 2, 3) for s in (10, 100, 200)
    ]
    attempts += [("bad", 0, "u", at(50), True, "ack", at(50)), ("null", None, None, at(60), True, "ack", at(60))]
    tick = (None,) * 6 + (at(90_000),)
    ads = [(1, 7, "https://a", True), (2, 7, "https://b", True)]
    # Ad 2 is switched off at 100, ad 3 made at 150; then the feed is silent.
    changes = [
        (2, 7, "https://b", False, at(100)),
        (3, 8, "https://c", True, at(150)),
    ]
    early = [a for a in attempts if a[3] < at(100)]
    late = [a for a in attempts if a[3] >= at(100)]
    log, checkpoint, job, source, progress = _accepted(spark, tmp_path, [early, [*late, tick]], ads, changes)
    found = {r.click_id: (r.status, r.advertiser_id) for r in log.read("outcomes", OUTCOME).collect()}
    gone = ("not_found", None)
    assert found == {
        "1-10": ("accepted", 7),
        "1-100": ("accepted", 7),
        "1-200": ("accepted", 7),
        "2-10": ("accepted", 7),
        "2-100": gone,
        "2-200": gone,
        "3-10": gone,
        "3-100": gone,
        "3-200": ("accepted", 8),
    }
    rejects = {r.click_id: len(r.broken_rules) for r in log.read("rejects", REJECT).collect()}
    assert set(rejects) == {"bad", "null"} and all(rejects.values())
    assert log.read("records", "key string, value string").count() == 5

    # The last batch again, as after a crash before Spark's own commit: nothing changes.
    commits = os.path.join(checkpoint, "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in os.listdir(commits):
        if name in (str(last), f".{last}.crc"):
            os.remove(os.path.join(commits, name))
    before = log.folders("records")
    job(spark.readStream.schema(LATE_ATTEMPT).parquet(source)).awaitTermination()
    assert log.folders("records") == before
    assert log.read("outcomes", OUTCOME).count() + len(rejects) == len(attempts)


def test_the_log_shows_commits_only(spark, tmp_path):
    from clickloom.streaming.log import VersionedLog

    log = VersionedLog(spark, str(tmp_path / "log"))
    assert log.read("n", "id long").count() == 0 and log.last_batches() == {}
    assert log.commit(0, {"n": spark.range(5), "m": spark.range(1)})
    seen = log.read("n", "id long")
    # Again, and an attempt that died before its commit: neither is seen.
    assert not log.commit(0, {"n": spark.range(50), "m": spark.range(1)})
    spark.range(9).write.parquet(f"{log.path}/data/dead/n")
    assert log.commit(1, {"n": spark.range(5, 7)})
    assert log.read("n", "id long").count() == 7 and seen.count() == 5
    # One commit in place of two; what a reader holds stays until the vacuum.
    spark.range(7).write.parquet(f"{log.path}/data/merged/n")
    log.merge({0: 1}, {"n": [f"{log.path}/data/merged/n"]})
    assert log.folders("n") == [f"{log.path}/data/merged/n"] and seen.count() == 5
    assert log.committed(0) and log.committed(1) and not log.commit(1, {"n": spark.range(1)})
    assert log.commit(2, {"n": spark.range(7, 8)}) and log.last_batches() == {0: 2}
    assert log.vacuum() == 3
    assert sorted(r.id for r in log.read("n", "id long").collect()) == list(range(8))
