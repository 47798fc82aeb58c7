"""Percentiles from sketches that are kept and merged: approximate, and never read twice.

A KLL sketch of each (runner, bucket) is a few kilobytes whatever it has seen. Stored beside the
counts, sketches merge up any roll-up, by runner, by hour or over all, without the samples. A
hot runner reaches the shuffle as one sketch for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.timebuckets import floor_div

K = 2000


def rank_error(k: int = K) -> float:
    """How far the rank of a reported quantile is from the wanted one, as a share, in 99 of 100 cases."""
    return 2.296 / k**0.9021


def latency_sketches(
    samples: DataFrame,
    bucket_seconds: int,
    keys: tuple[str, ...] = ("runner",),
    value: str = "metric_value",
    time: str = "timestamp",
    k: int = K,
) -> DataFrame:
    """``(*keys, bucket, n, sketch)`` of the samples with a value; bucket in epoch seconds."""
    held = samples.where(F.col(value).isNotNull() & ~F.isnan(value))
    bucket = floor_div(F.col(time), bucket_seconds) * F.lit(bucket_seconds)
    return held.groupBy(*keys, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value), k).alias("sketch")
    )


def merged(sketches: DataFrame, *keys: str | Column) -> DataFrame:
    """Sketches of coarser groups: ``(*keys, n, sketch)``."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def with_quantiles(sketches: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """The percentiles by name, in place of the sketch."""
    found = [
        F.kll_sketch_get_quantile_double("sketch", F.lit(percent / 100)).alias(name)
        for name, percent in wanted.items()
    ]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *found)
