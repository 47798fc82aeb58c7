import random

from pyspark.sql import functions as F

from clickloom.operators import sketches
from helpers import plan_of

SCHEMA = "runner string, timestamp long, metric_value double"


def test_merged_sketches_are_within_the_stated_error(spark):
    pick = random.Random(2)
    rows = [
        (pick.choice(["a", "a", "b"]), pick.randrange(20_000), pick.expovariate(0.01)) for _ in range(30_000)
    ]
    rows += [("a", 5, None), ("b", 5, float("nan")), ("c", 7, 3.0)]
    samples = spark.createDataFrame(rows, SCHEMA)
    hourly = sketches.latency_sketches(samples, 3600, k=400)
    by_runner = sketches.merged(hourly, "runner")
    every = sketches.merged(by_runner, F.lit("all").alias("runner"))
    wanted = {"p50": 50, "p95": 95, "p99": 99}
    found = sketches.with_quantiles(by_runner.unionByName(every), wanted).collect()
    assert {r.runner for r in found} == {"a", "b", "c", "all"}
    for row in found:
        values = [v for g, _, v in rows if v is not None and v == v and row.runner in (g, "all")]
        assert row.n == len(values)
        for name, percent in wanted.items():
            below = sum(v < row[name] for v in values) / len(values)
            upto = sum(v <= row[name] for v in values) / len(values)
            margin = 4 * sketches.rank_error(400)
            assert below <= percent / 100 + margin and upto >= percent / 100 - margin


def test_no_samples_give_no_sketch(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sketches.merged(sketches.latency_sketches(empty, 60), "runner").count() == 0


def test_sketches_are_made_before_the_shuffle(spark):
    rows = [("a", 1, 1.0)]
    plan = plan_of(sketches.latency_sketches(spark.createDataFrame(rows, SCHEMA), 60))
    assert "partial_kll_sketch_agg_double" in plan
