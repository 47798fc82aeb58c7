"""From attempts to published events: outcomes, hot ads, tags, salts and keys in one go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from clickloom.operators import dedup, hot
from clickloom.session import stored
from clickloom.sources.clicks import assign_salt, encode_events


@dataclass(frozen=True)
class Accepted:
    """``outcomes``: every attempt with ``status`` and ``hot``. ``events``: accepted clicks, salted."""

    outcomes: DataFrame
    markings: DataFrame
    events: DataFrame

    def records(self, salting: bool = True) -> DataFrame:
        return encode_events(self.events, salting)


def accept(
    attempts: DataFrame,
    ads: DataFrame,
    rules: hot.HotRules = hot.HotRules(),
    ttl_seconds: int = dedup.DEDUP_TTL_SECONDS,
    visible_after: int = 0,
    salting: bool = True,
    receiver: str = "spark",
) -> Accepted:
    """Classify attempts, find hot ads from the accepted ones, and prepare those for the topic.

    The outcomes are written once to the shared folder: three later steps read a few of their
    columns. Duplicates and failures never feed the hot counters.
    """
    classified = stored(
        dedup.classify_attempts(attempts, ads, ttl_seconds).withColumnRenamed("attempted_at", "clicked_at"),
        "outcomes",
    )
    accepted = classified.where("status = 'accepted'")
    buckets = stored(hot.hot_buckets(accepted, rules), "hot-buckets")
    markings = stored(hot.hot_intervals(accepted, rules, buckets=buckets), "markings")
    outcomes = hot.tag_hot_clicks(
        classified, markings, slot_seconds=rules.ttl_seconds, visible_after=visible_after
    )
    events = assign_salt(
        outcomes.where("status = 'accepted'").withColumn("receiver", F.lit(receiver)), salting
    )
    return Accepted(outcomes, markings, events)
