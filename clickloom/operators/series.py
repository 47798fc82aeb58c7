"""Time series over the counts: roll-ups, zero-fill, per-ad totals and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.spans import Span
from clickloom.functions.timebuckets import GRANULARITIES, STEP_SQL, bucket_floor


def in_span(counts: DataFrame, span: Span, advertiser_id: int | None = None) -> DataFrame:
    """Counts of a span and an owner; both predicates, and the day folders, reach the scan."""
    found = counts.where(span.holds(F.col("minute")))
    if "day" in counts.columns:
        found = found.where(F.col("day").between(*map(F.lit, span.days)))
    if advertiser_id is not None:
        found = found.where(F.col("advertiser_id") == advertiser_id)
    return found


def _measures() -> list[Column]:
    return [
        F.sum("click_count").alias("clicks"),
        F.max("updated_at").alias("last_updated_at"),
    ]


def rollup(counts: DataFrame, granularity: str, *keys: str) -> DataFrame:
    """Clicks and freshness per bucket, for each value of ``keys``."""
    return counts.groupBy(
        *keys, bucket_floor(F.col("minute"), granularity).alias("bucket")
    ).agg(*_measures())


def ad_points(counts: DataFrame, advertiser_id: int, ad_id: int, span: Span) -> DataFrame:
    """The non-empty buckets of one ad; another advertiser's ad has none."""
    mine = in_span(counts, span, advertiser_id).where(F.col("ad_id") == ad_id)
    return rollup(mine, span.granularity)


def advertiser_groups(counts: DataFrame, advertiser_id: int, span: Span) -> DataFrame:
    """Buckets and per-ad totals from one scan; ``grouping`` tells them apart (1 bucket, 2 ad)."""
    mine = in_span(counts, span, advertiser_id).select(
        bucket_floor(F.col("minute"), span.granularity).alias("bucket"),
        "ad_id",
        "click_count",
        "updated_at",
    )
    return mine.groupingSets([["bucket"], ["ad_id"]], "bucket", "ad_id").agg(
        F.grouping_id().alias("grouping"), *_measures()
    )


def points_of(groups: DataFrame) -> DataFrame:
    return groups.where(F.col("grouping") == 1).select("bucket", "clicks", "last_updated_at")


def by_ad_of(groups: DataFrame) -> DataFrame:
    """Per-ad totals above zero, most clicks first; ad id breaks ties."""
    return (
        groups.where((F.col("grouping") == 2) & (F.col("clicks") > 0))
        .select("ad_id", "clicks")
        .orderBy(F.desc("clicks"), "ad_id")
    )


def zero_fill(points: DataFrame, span: Span) -> DataFrame:
    """One row per bucket of the span; buckets without a point get 0.

    Buckets outside the span are dropped first, so that both sides have at most ``MOST_BUCKETS``
    rows and the points may be broadcast.
    """
    buckets = span.spine(points.sparkSession)
    inside = points.where(span.holds(F.col("bucket")))
    return buckets.join(F.broadcast(inside), "bucket", "left").withColumn(
        "clicks", F.coalesce("clicks", F.lit(0).cast("long"))
    )


def zero_fill_per(points: DataFrame, span: Span, *keys: str) -> DataFrame:
    """Zero-filled series of every key that has a point.

    Each point also emits the empty buckets up to the next one, the first point those before
    it. A key has at most ``MOST_BUCKETS`` points, so its window is small; nothing is joined.
    """
    span.check_size()
    step = F.expr(STEP_SQL[span.granularity])
    in_time = Window.partitionBy(*keys).orderBy("bucket")
    first = F.when(F.lag("bucket").over(in_time).isNull(), F.lit(span.start)).otherwise(F.col("bucket"))
    until = F.coalesce(F.lead("bucket").over(in_time), F.lit(span.end))
    own = F.col("at") == F.col("bucket")
    return (
        points.withColumns({"first": first, "until": until})
        .withColumn("at", F.explode(F.sequence("first", F.col("until") - step, step)))
        .select(
            *keys,
            F.col("at").alias("bucket"),
            F.when(own, F.col("clicks")).otherwise(F.lit(0).cast("long")).alias("clicks"),
            F.when(own, F.col("last_updated_at")).alias("last_updated_at"),
        )
    )


def ad_series(counts: DataFrame, advertiser_id: int, ad_id: int, span: Span) -> DataFrame:
    """Zero-filled series of one ad, in time order."""
    return zero_fill(ad_points(counts, advertiser_id, ad_id, span), span).orderBy("bucket")


def advertiser_series(counts: DataFrame, advertiser_id: int, span: Span) -> DataFrame:
    """Zero-filled series of one advertiser, in time order."""
    return zero_fill(points_of(advertiser_groups(counts, advertiser_id, span)), span).orderBy("bucket")


def series_totals(points: DataFrame) -> DataFrame:
    """Total and freshness of a series; freshness is null where nothing was counted."""
    return points.agg(
        F.coalesce(F.sum("clicks"), F.lit(0).cast("long")).alias("total"),
        F.max("last_updated_at").alias("last_updated_at"),
    )


def rollup_consistency(counts: DataFrame, span: Span) -> DataFrame:
    """Totals of the same range per minute, hour and day from one scan, and whether they agree.

    The range must lie on day boundaries.
    """
    levels = in_span(counts, span).select(
        *[bucket_floor(F.col("minute"), name).alias(f"by_{name}") for name in GRANULARITIES],
        "click_count",
    )
    names = [f"by_{name}" for name in GRANULARITIES]
    rolled = levels.groupingSets([[name] for name in names], *names).agg(F.sum("click_count").alias("clicks"))
    zero = F.lit(0).cast("long")
    return rolled.agg(
        *[
            F.coalesce(F.sum(F.when(F.col(f"by_{name}").isNotNull(), F.col("clicks"))), zero).alias(
                f"{name}_total"
            )
            for name in GRANULARITIES
        ]
    ).withColumn(
        "consistent",
        (F.col("minute_total") == F.col("hour_total")) & (F.col("hour_total") == F.col("day_total")),
    )
