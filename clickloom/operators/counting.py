"""Exact per-ad, per-minute counts and the change log that carries them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.timebuckets import minute_floor
from clickloom.operators.filtering import as_of_column, keep_click

COUNT_KEY = ("ad_id", "minute")


def salted_partials(kept: DataFrame) -> DataFrame:
    """First stage: clicks per ad, advertiser, salt and minute."""
    return kept.groupBy(
        "ad_id", "advertiser_id", "salt", minute_floor(F.col("clicked_at")).alias("minute")
    ).agg(F.count(F.lit(1)).alias("partial"))


def sum_partials(partials: DataFrame, updated_at: Column | datetime | None) -> DataFrame:
    """Second stage: one absolute count per ad and minute."""
    return (
        partials.groupBy(*COUNT_KEY)
        .agg(
            F.max("advertiser_id").alias("advertiser_id"),
            F.sum("partial").alias("click_count"),
        )
        .withColumn("updated_at", as_of_column(updated_at))
        .select("ad_id", "advertiser_id", "minute", "click_count", "updated_at")
    )


def salted_minute_counts(kept: DataFrame, updated_at: Column | datetime | None = None) -> DataFrame:
    """Both stages, with clicks salted by key. Same rows as :func:`minute_counts`."""
    return sum_partials(salted_partials(kept), updated_at)


def minute_counts(kept: DataFrame, updated_at: Column | datetime | None = None) -> DataFrame:
    """One absolute count per ad and minute.

    Spark's partial aggregate already reduces a hot ad to one row per task and minute
    before the shuffle, so one exchange does what the salted stages do with two.
    """
    return (
        kept.groupBy("ad_id", minute_floor(F.col("clicked_at")).alias("minute"))
        .agg(
            F.max("advertiser_id").alias("advertiser_id"),
            F.count(F.lit(1)).alias("click_count"),
        )
        .withColumn("updated_at", as_of_column(updated_at))
        .select("ad_id", "advertiser_id", "minute", "click_count", "updated_at")
    )


def recount(clicks: DataFrame, updated_at: Column | datetime | None = None) -> DataFrame:
    """Count raw clicks again without a lateness cutoff, to repair late or lost counts."""
    return minute_counts(keep_click(clicks, as_of=None, cutoff_ms=None), updated_at)


# Bits of one long for the number of a run and of its batch.
RUN_BITS, BATCH_BITS = 22, 40


def newest(order: Column, *columns: str) -> list[Column]:
    """Each column's value in the row with the highest ``order``.

    Taken one by one, with a plain number as the order, the aggregate hashes; whole rows or a
    compound order would make it sort its input.
    """
    return [F.max_by(name, order).alias(name) for name in columns]


def upsert_latest(versions: DataFrame) -> DataFrame:
    """The current table: for each key the version with the highest ``(run_seq, batch_id)``."""
    run, batch = F.col("run_seq"), F.col("batch_id")
    fits = run.between(0, (1 << RUN_BITS) - 1) & batch.between(0, (1 << BATCH_BITS) - 1)
    order = F.when(fits, F.shiftleft(run, BATCH_BITS) + batch).otherwise(
        F.raise_error("run_seq or batch_id is too large to be ordered").cast("long")
    )
    return (
        versions.groupBy(*COUNT_KEY)
        .agg(*newest(order, "advertiser_id", "click_count", "updated_at"))
        .select("ad_id", "advertiser_id", "minute", "click_count", "updated_at")
    )


def repair_counts(current: DataFrame, recounted: DataFrame) -> DataFrame:
    """Overwrite the keys a recount touched; keep the others."""
    old = current.withColumns({"run_seq": F.lit(0).cast("long"), "batch_id": F.lit(0).cast("long")})
    new = recounted.withColumns({"run_seq": F.lit(1).cast("long"), "batch_id": F.lit(0).cast("long")})
    return upsert_latest(old.unionByName(new))
