"""What the streams ask of the state store grows with slots of time and shards, not with rows."""

from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from clickloom.operators.hot import HotRules
from clickloom.streaming import sinks, stateful


class Map(dict):
    """A map state that counts its calls."""

    calls = 0

    def updateValue(self, key, value):
        Map.calls += 1
        self[key] = value

    def getValue(self, key):
        Map.calls += 1
        return self[key]

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        Map.calls += 1
        self.pop(key, None)

    def iterator(self):
        Map.calls += len(self)
        return iter(list(self.items()))

    def keys(self):
        Map.calls += 1
        return list(super().keys())


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *names):
        return Map()

    def getValueState(self, *names):
        held = []
        return SimpleNamespace(get=lambda: held[-1] if held else None, update=held.append)

    def registerTimer(self, at):
        self.timers.add(at)


def run_timers(processor, handle, watermark):
    """Call the timers that are over as Spark does; what they give, and how many there were."""
    times, found, due = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), [], 0
    for at in sorted(t for t in handle.timers if t <= watermark):
        found += processor.handleExpiredTimer((1,), times, None)
        handle.timers.discard(at)
        due += 1
    return found, due


def test_an_ad_with_many_waiting_instants_has_one_timer():
    rules, handle = HotRules(threshold=5), Handle()
    processor = stateful.HotProcessor(rules, True)
    processor.init(handle)
    start = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    Map.calls = 0
    rows = [Row(ad_id=1, t=t, n=1) for t in range(600, 9_600, 3)]
    assert not list(processor.handleInputRows((1,), iter(rows), start))
    found, due = run_timers(processor, handle, 9_000_000)
    assert due == 1
    assert [(r.mark_no, r.first) for r in found] == [(1, 612)]
    # 150 buckets; an entry, a timer and a pass over all for each of 3,000 instants would be millions
    assert Map.calls < 1_500
    # what is left is answered in its turn
    found, _ = run_timers(processor, handle, 12_000_000)
    assert [(r.mark_no, r.last) for r in found] == [(1, 9_597)]
    assert not run_timers(processor, handle, 12_000_000)[1]


def test_pairs_share_the_state_of_their_shard(spark, tmp_path):
    folder, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "ck"))
    attempts = spark.range(12_000).select(
        F.col("id").cast("string").alias("click_id"),
        F.lit(1).cast("long").alias("ad_id"),
        F.concat(F.lit("u"), F.col("id") % 6_000).alias("user_id"),
        F.timestamp_seconds(F.col("id") % 100 + 1_700_000_000).alias("attempted_at"),
        F.lit(True).alias("dedup_ok"),
        F.lit("ack").alias("produce"),
    )
    attempts.write.parquet(folder)
    stream = spark.readStream.schema(attempts.schema).parquet(folder)
    query = sinks.start_log(
        stateful.stream_dedup(stream, 600, 7_200), log, checkpoint, "append", available_now=True
    )
    query.awaitTermination()
    found = {r.status: r["count"] for r in spark.read.parquet(log).groupBy("status").count().collect()}
    assert found == {"accepted": 6_000, "duplicate": 6_000}
    # a key for each pair has 6,000 claims, and timers besides
    rows = max(p.stateOperators[0].numRowsTotal for p in query.recentProgress)
    assert rows <= 5 * stateful.SHARDS
