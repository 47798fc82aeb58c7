"""A key with a third of all rows does not stay in one task."""

import pytest
from pyspark.sql import functions as F

from clickloom.operators import skew
from helpers import plan_of

SMALL_PARTITIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    old = {key: spark.conf.get(key, None) for key in SMALL_PARTITIONS}
    for key, value in SMALL_PARTITIONS.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _facts(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(0, 60_000, 1, 8).select(
        F.when(hot, F.lit(7)).otherwise(F.col("id") % 997).cast("long").alias("k"),
        F.xxhash64("id").alias("payload"),
    )


def _lookup(spark):
    return _facts(spark).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def _final_plan(frame):
    frame.collect()
    plan = plan_of(frame)
    return plan[: plan.index("Initial Plan")]


def test_a_lookup_out_of_an_aggregate_is_split_at_run_time(spark, small_partitions):
    facts, lookup = _facts(spark), _lookup(spark)
    plain = facts.join(lookup, "k", "left")
    split = skew.splittable_lookup(facts, lookup, ["k"], "k")
    assert "skew=true" not in _final_plan(plain)
    assert "skew=true" in _final_plan(split)
    assert split.select("k", "payload", "n").exceptAll(plain.select("k", "payload", "n")).count() == 0
    assert split.count() == 60_000


def test_a_salted_lookup_spreads_the_key(spark, small_partitions):
    spread = skew.salted_lookup(_facts(spark), _lookup(spark), ["k"], F.col("payload"), "left")
    sizes = spread.where("k = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) > 4
    assert sum(r["count"] for r in sizes) == _facts(spark).where("k = 7").count()


def test_dedup_divides_a_burst_on_one_key(spark, small_partitions):
    from clickloom.operators import dedup

    hot = F.col("id") % 3 == 0
    attempts = spark.range(0, 30_000, 1, 8).select(
        F.col("id").cast("string").alias("click_id"),
        F.when(hot, F.lit(1)).otherwise(F.col("id") % 50).cast("long").alias("ad_id"),
        F.when(hot, F.lit("bot")).otherwise(F.concat(F.lit("u"), F.col("id") % 400)).alias("user_id"),
        F.timestamp_seconds(F.when(hot, F.col("id") % 500).otherwise(F.col("id") * 60)).alias("attempted_at"),
    )
    outcomes = dedup.dedup_clicks(attempts, 600)
    assert "skew=true" in _final_plan(outcomes)
    burst = outcomes.where("user_id = 'bot' and status = 'accepted'")
    assert burst.count() == 1 and outcomes.count() == 30_000
