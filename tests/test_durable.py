"""Counting over lost checkpoints, and compaction of its log."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.plans import streams  # noqa: F401  (registers the streaming queries)
from clickloom.plans.queries import QUERIES
from clickloom.sources.tables import read_counts
from clickloom.streaming import counts, durable
from clickloom.streaming.log import VersionedLog
from helpers import naive, utc

NOW = utc(2026, 9, 26, 12)
CLICK = (
    "click_id string, ad_id long, advertiser_id long, salt int, user_id string, clicked_at timestamp,"
    " partition int, offset long"
)


def drawn(seed, count):
    """Clicks of the last half hour in disorder, every partition with its own offsets."""
    pick, offsets, rows = random.Random(seed), {}, []
    for n in range(count):
        ad, partition = pick.choice([1, 1, 1, 2, 3]), pick.randrange(3)
        offsets[partition] = offsets.get(partition, -1) + 1
        late = 7200 if pick.random() < 0.1 else 0
        at = NOW - timedelta(seconds=pick.randrange(1800) + late)
        salt = None if pick.random() < 0.05 else 0
        rows.append((f"{n}", ad, ad + 10, salt, "u", at, partition, offsets[partition]))
    return rows


def walked(rows):
    found = {}
    for _, ad, owner, salt, _, at, _, _ in rows:
        if salt is not None and NOW - at <= timedelta(hours=1):
            minute = at.replace(second=0, microsecond=0, tzinfo=None)
            found[ad, owner, minute] = found.get((ad, owner, minute), 0) + 1
    return sorted((*key, n) for key, n in found.items())


class Counting:
    def __init__(self, spark, root):
        self.spark, self.source, self.path = spark, str(root / "in"), str(root / "log")
        self.root, self.log = root, VersionedLog(spark, str(root / "log"))

    def add(self, rows):
        self.spark.createDataFrame(rows, CLICK).coalesce(1).write.mode("append").parquet(self.source)

    def run(self, checkpoint):
        stream = self.spark.readStream.schema(CLICK).option("maxFilesPerTrigger", 1).parquet(self.source)
        query = durable.start_durable_counts(
            stream,
            self.path,
            str(self.root / checkpoint),
            counts.CountingConfig(),
            as_of=F.lit(NOW),
            available_now=True,
        )
        query.awaitTermination()
        return query

    def current(self):
        found = durable.current_counts(self.log).collect()
        return sorted((r.ad_id, r.advertiser_id, naive(r.minute), r.click_count) for r in found)


def test_lost_checkpoints_lose_and_double_nothing(spark, tmp_path):
    job, rows = Counting(spark, tmp_path), drawn(4, 400)
    steps = [rows[:100], rows[100:180], rows[180:300], rows[300:]]
    for at, checkpoint in enumerate(["a", "b", "b", "c"]):
        job.add(steps[at])
        job.run(checkpoint)
        assert job.current() == walked(rows[: sum(map(len, steps[: at + 1]))])
    assert set(job.log.last_batches()) == {0, 1, 2}
    # One that a later run has gone on from would count the same clicks once more.
    with pytest.raises(ValueError, match="run 2"):
        job.run("b")


def test_a_batch_that_spark_did_not_commit_is_not_counted_twice(spark, tmp_path):
    job, rows = Counting(spark, tmp_path), drawn(5, 200)
    job.add(rows[:150])
    job.run("a")
    # The log has the batch, the checkpoint is gone: the next run passes its records over.
    job.run("b")
    assert job.current() == walked(rows[:150])
    job.add(rows[150:])
    job.run("b")
    assert job.current() == walked(rows)


def test_closed_days_move_in_one_commit(spark, tmp_path):
    job, rows = Counting(spark, tmp_path), drawn(6, 120)
    job.add(rows[:60])
    job.run("a")
    day = date(2026, 9, 27)
    durable.close_days(job.log, day)
    assert job.current() == walked(rows[:60]) and len(job.log.folders("days")) == 1
    held = durable.current_counts(job.log)
    durable.close_days(job.log, day)
    # Readers of the state before keep it until the vacuum.
    assert held.count() == len(walked(rows[:60])) and job.current() == walked(rows[:60])
    assert job.log.vacuum() > 0 and job.current() == walked(rows[:60])
    plan = VersionedLog(spark, job.path).folders("days")
    assert len(plan) == 2


def test_expired_minutes_leave_the_state(spark, tmp_path):
    job, rows = Counting(spark, tmp_path), drawn(7, 100)
    job.add(rows)
    query = job.run("a")
    # Everything is within the hour: all minutes are still held.
    assert query.lastProgress.stateOperators[0].numRowsTotal == len({r[:3] for r in walked(rows)})


def test_a_job_without_a_cutoff_is_refused(spark, tmp_path):
    job = Counting(spark, tmp_path)
    job.add(drawn(8, 5))
    stream = spark.readStream.schema(CLICK).parquet(job.source)
    with pytest.raises(ValueError, match="cutoff"):
        durable.start_durable_counts(stream, job.path, str(tmp_path / "ck"), counts.CountingConfig(None))


def test_a_batch_run_again_after_its_commit_changes_nothing(spark, tmp_path):
    import os

    job, rows = Counting(spark, tmp_path), drawn(9, 150)
    job.add(rows[:80])
    job.run("a")
    before = job.log.folders("counts")
    commits = str(tmp_path / "a" / "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in os.listdir(commits):
        if name in (str(last), f".{last}.crc"):
            os.remove(os.path.join(commits, name))
    job.run("a")
    assert job.log.folders("counts") == before
    job.add(rows[80:])
    job.run("a")
    assert job.current() == walked(rows)


def test_the_query_loses_a_checkpoint_with_counts_and_closes_days_with_rows(spark, tmp_path, monkeypatch):
    began, pick = datetime(2024, 1, 1), random.Random(10)
    # Every hour of January, what is much older, what is dated ahead, and what has no time.
    times = [began + timedelta(hours=n, minutes=pick.randrange(3)) for n in range(720)] * 2
    times += [datetime(2023, 11, 5), datetime(2024, 2, 20), None]
    events = [(n, at, pick.randrange(50), '{"k": %d}' % pick.randrange(4)) for n, at in enumerate(times)]
    made = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, props string")
    made.write.parquet(str(tmp_path / "events.parquet"))
    plain, logs, places = durable.read_places, [], []

    def spied(log, run):
        logs.append(log)
        places.append(plain(log, run))
        return places[-1]

    monkeypatch.setattr(durable, "read_places", spied)
    found = QUERIES["stream_lost_checkpoint"](spark, str(tmp_path)).collect()
    wanted = {}
    for n, at, _, props in events:
        if n % 50 and at is not None:
            key = int(props[6:-1]) + 1, at.replace(second=0)
            wanted[key] = wanted.get(key, 0) + 1
    assert {(r.ad_id, naive(r.minute)): r.click_count for r in found} == wanted
    # The lost checkpoint had read all partitions, and each restart knows it.
    assert [len(read) for read in places] == [0, 7, 7]
    closed = [naive(r.minute) for part in logs[-1].folders("days") for r in read_counts(spark, part).collect()]
    assert min(closed) == datetime(2023, 11, 5) and max(closed).date() == date(2024, 1, 10)
