"""Hot ads: sliding sums over click buckets, markings with expiry, permanence, tagging.

An ad is evaluated at every instant (of ``resolution`` seconds) in which it was clicked: the
clicks of the current bucket so far plus those of the previous ``window_buckets - 1`` buckets.
At or above ``threshold`` the ad is marked if it carries no live mark, else the mark is
extended; a mark expires ``ttl`` after the last such instant. The ``permanent_after``-th marking
is for good.

Clicks first collapse to one row per ad and bucket, with map-side combining. Only buckets whose
window reaches the threshold are looked at instant by instant. Windows run per ad and
*stretch* of buckets, not per ad: each stretch is also shown the last buckets of the stretch
before it, so that a busy ad's history is spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.timebuckets import floor_div, floor_to
from clickloom.operators.filtering import as_of_column
from clickloom.operators.skew import salted_lookup, splittable_lookup


@dataclass(frozen=True)
class HotRules:
    """The defaults are fixed values; scale them for sparser data."""

    bucket_seconds: int = 60
    window_buckets: int = 10
    threshold: int = 1200
    ttl_seconds: int = 600
    permanent_after: int = 10
    resolution: int = 1
    stretch_buckets: int = 720

    def __post_init__(self) -> None:
        if self.bucket_seconds % self.resolution:
            raise ValueError("resolution must divide bucket_seconds")
        if self.stretch_buckets < self.window_buckets:
            raise ValueError("stretch_buckets must be at least window_buckets")


def _in_stretches(rows: DataFrame, rules: HotRules) -> DataFrame:
    """Rows by stretch of buckets; the last buckets of one are also shown (not own) to the next."""
    stretch = floor_div(F.col("bucket"), rules.stretch_buckets)
    ends_at = (stretch + 1) * F.lit(rules.stretch_buckets)
    seen_next = F.col("bucket") >= ends_at - F.lit(rules.window_buckets - 1)
    here = F.struct(stretch.alias("stretch"), F.lit(True).alias("own"))
    there = F.struct((stretch + 1).alias("stretch"), F.lit(False).alias("own"))
    places = F.when(seen_next, F.array(here, there)).otherwise(F.array(here))
    return rows.withColumn("place", F.explode(places)).select(*rows.columns, "place.*")


def sliding_totals(clicks: DataFrame, rules: HotRules = HotRules(), time: str = "clicked_at") -> DataFrame:
    """Per ad and bucket: its clicks ``n`` and ``total`` over the window ending with it."""
    bucket = floor_div(F.unix_seconds(time), rules.bucket_seconds)
    buckets = clicks.groupBy("ad_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    window = (
        Window.partitionBy("ad_id", "stretch")
        .orderBy("bucket")
        .rangeBetween(-(rules.window_buckets - 1), 0)
    )
    return (
        _in_stretches(buckets, rules)
        .withColumn("total", F.sum("n").over(window))
        .where("own")
        .select("ad_id", "bucket", "n", "total")
    )


def hot_buckets(clicks: DataFrame, rules: HotRules = HotRules(), time: str = "clicked_at") -> DataFrame:
    """Buckets by whose end an ad's window reaches the threshold, and the clicks ``before`` them.

    Only these can hold an over-threshold instant. For most traffic they are few, so finer
    steps read little; store them (``session.stored``) and they are broadcast while small.
    """
    return (
        sliding_totals(clicks, rules, time)
        .where(F.col("total") >= rules.threshold)
        .select("ad_id", "bucket", (F.col("total") - F.col("n")).alias("before"))
    )


def _over_threshold(clicks: DataFrame, rules: HotRules, time: str, buckets: DataFrame) -> DataFrame:
    """Instants at which an ad's window reaches the threshold: ``(ad_id, stretch, t)``.

    Clicks are counted by instant before they meet the buckets: a hot ad is then at most a row for
    each instant and task, wherever the join puts it.
    """
    t = floor_to(F.unix_seconds(time), rules.resolution)
    instants = (
        clicks.groupBy("ad_id", t.alias("t"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", floor_div(F.col("t"), rules.bucket_seconds))
        .join(buckets, ["ad_id", "bucket"])
    )
    so_far = (
        Window.partitionBy("ad_id", "bucket")
        .orderBy("t")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        instants.withColumn("in_bucket", F.sum("n").over(so_far))
        .where(F.col("in_bucket") + F.col("before") >= rules.threshold)
        .select("ad_id", floor_div(F.col("bucket"), rules.stretch_buckets).alias("stretch"), "t")
    )


def _islands(rows: DataFrame, keys: list[str], first: str, last: str, ttl: int) -> DataFrame:
    """Merge rows (ordered by ``first``) whose gap to the one before is shorter than ``ttl``."""
    order = Window.partitionBy(*keys).orderBy(first)
    gap = F.col(first) - F.lag(last).over(order)
    starts = F.when(gap.isNull() | (gap >= ttl), 1).otherwise(0)
    numbered = rows.withColumn("starts", starts).withColumn(
        "mark_no", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*keys, "mark_no").agg(
        F.min(first).alias("first"), F.max(last).alias("last")
    )


def hot_intervals(
    clicks: DataFrame,
    rules: HotRules = HotRules(),
    time: str = "clicked_at",
    buckets: DataFrame | None = None,
) -> DataFrame:
    """Markings ``(ad_id, mark_no, marked_at, hot_until, permanent)``.

    ``buckets`` are the :func:`hot_buckets` of the same clicks, if they are stored already.
    Over-threshold instants first merge inside their stretch; only the merged pieces, at most
    a stretch's length over the ttl of them, meet per ad to be numbered.
    """
    ttl = rules.ttl_seconds
    if buckets is None:
        buckets = hot_buckets(clicks, rules, time)
    over = _over_threshold(clicks, rules, time, buckets)
    pieces = _islands(over, ["ad_id", "stretch"], "t", "t", ttl).select("ad_id", "first", "last")
    marked = _islands(pieces, ["ad_id"], "first", "last", ttl)
    return marked.select(
        "ad_id",
        F.col("mark_no").cast("long").alias("mark_no"),
        F.timestamp_seconds("first").alias("marked_at"),
        F.timestamp_seconds(F.col("last") + ttl).alias("hot_until"),
        (F.col("mark_no") >= rules.permanent_after).alias("permanent"),
    )


def permanent_hot(intervals: DataFrame) -> DataFrame:
    """Ads hot for good and since when."""
    return (
        intervals.where("permanent").groupBy("ad_id").agg(F.min("marked_at").alias("permanent_since"))
    )


def up_to(clicks: DataFrame, as_of: datetime | Column, time: str = "clicked_at") -> DataFrame:
    """The clicks known at ``as_of``."""
    return clicks.where(F.col(time) <= as_of_column(as_of))


def hot_view(intervals: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Ads hot at ``as_of``, by ad id, from the intervals of the clicks :func:`up_to` then.

    ``hot_until`` is null for a permanent ad without a live mark.
    """
    live = F.col("hot_until") >= as_of_column(as_of)
    return (
        intervals.groupBy("ad_id")
        .agg(
            F.bool_or("permanent").alias("permanent"),
            F.max("mark_no").alias("marks"),
            F.max(F.when(live, F.col("hot_until"))).alias("hot_until"),
        )
        .where(F.col("permanent") | F.col("hot_until").isNotNull())
        .orderBy("ad_id")
    )


def hot_ranking(view: DataFrame) -> DataFrame:
    """Permanent ads first, then the most often marked."""
    return view.orderBy(F.desc("permanent"), F.desc("marks"), "ad_id")


def hot_gauges(view: DataFrame) -> DataFrame:
    return view.agg(
        F.count(F.lit(1)).alias("hot_ads"), F.count_if("permanent").alias("hot_ads_permanent")
    )


def tag_hot_clicks(
    clicks: DataFrame,
    intervals: DataFrame,
    slot_seconds: int = 600,
    visible_after: int = 0,
    time: str = "clicked_at",
) -> DataFrame:
    """Add ``hot``: whether the ad was in the hot view, ``visible_after`` seconds behind, at the click.

    Intervals are laid out on time slots, so a click meets only those of its own ad and slot.
    The slot table has one row per ad and slot and the join adds no rows. Intervals are read
    twice: give a stored table (``session.stored``), whose size Catalyst knows.
    """
    slot = floor_div(F.unix_seconds(time), slot_seconds)
    visible = F.unix_seconds("marked_at") + F.lit(visible_after)
    until = F.unix_seconds("hot_until")
    slots = (
        intervals.select("ad_id", visible.alias("visible"), until.alias("until"))
        .where(F.col("visible") <= F.col("until"))
        .select(
            "ad_id",
            F.explode(
                F.sequence(
                    floor_div(F.col("visible"), slot_seconds),
                    floor_div(F.col("until"), slot_seconds),
                )
            ).alias("slot"),
            F.struct(F.col("visible").alias("visible"), F.col("until").alias("until")).alias("span"),
        )
        .groupBy("ad_id", "slot")
        .agg(F.collect_list("span").alias("spans"))
    )
    since = permanent_hot(intervals).select(
        "ad_id", (F.col("permanent_since") + F.make_dt_interval(secs=F.lit(visible_after))).alias("since")
    )
    at = F.unix_micros(time)
    million = F.lit(1_000_000).cast("long")
    temporary = F.exists(
        "spans",
        lambda span: (at >= span["visible"] * million) & (at <= span["until"] * million),
    )
    slotted = splittable_lookup(clicks.withColumn("slot", slot), slots, ["ad_id", "slot"], "slot")
    return (
        salted_lookup(slotted, since, ["ad_id"], F.col(time), "left")
        .withColumn(
            "hot",
            F.coalesce(temporary, F.lit(False)) | F.coalesce(F.col(time) >= F.col("since"), F.lit(False)),
        )
        .select(*clicks.columns, "hot")
    )


def hot_share(tagged: DataFrame, time: str = "clicked_at") -> DataFrame:
    """Per ad: clicks, the share answered as hot, and when the first one was."""
    return tagged.groupBy("ad_id").agg(
        F.count(F.lit(1)).alias("clicks"),
        F.avg(F.col("hot").cast("int")).alias("hot_share"),
        F.min(F.when(F.col("hot"), F.col(time))).alias("first_hot_at"),
    )
