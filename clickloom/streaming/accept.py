"""The accepting path as one stream: attempts in, outcomes and events for the topic out.

Two stateful operators in one query. The first labels the attempts of each (ad, user), in order of
time; the second holds, for each ad in a shard of ads, its versions in the catalogue and its heat, and answers what the
ad was at the time of the click. It starts from a snapshot of the catalogue and follows its changes
as a second stream, so an ad counts from the instant it is made and ends when it is switched off,
wherever the job stands. Attempts that break a rule pass both by and come out with their reasons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators import hot
from clickloom.operators.dedup import DEDUP_TTL_SECONDS
from clickloom.operators.filtering import validate_attempts
from clickloom.sources.clicks import assign_salt, encode_events
from clickloom.streaming import stateful
from clickloom.streaming.log import VersionedLog

_COLUMNS = ("click_id", "ad_id", "user_id", "t", "tie")
_OUTCOMES = (
    "click_id string, ad_id long, user_id string, t long, tie long, status string,"
    " advertiser_id long, redirect_url string, hot boolean"
)


def _as_versions(changes: DataFrame) -> DataFrame:
    """Catalogue rows ``(id, advertiser_id, redirect_url, active, changed_at)`` as input rows."""
    nothing = F.lit(None)
    return changes.where("id IS NOT NULL").select(
        nothing.cast("string").alias("click_id"),
        F.col("id").alias("ad_id"),
        nothing.cast("string").alias("user_id"),
        F.unix_micros("changed_at").alias("t"),
        F.lit(0).cast("long").alias("tie"),
        nothing.cast("string").alias("status"),
        "advertiser_id",
        "redirect_url",
        "active",
        F.lit(True).alias("version"),
    )


def stream_outcomes(
    attempts: DataFrame,
    ads: DataFrame,
    changes: DataFrame | None = None,
    rules: hot.HotRules = hot.HotRules(),
    ttl_seconds: int = DEDUP_TTL_SECONDS,
    keep_state_seconds: int = 86_400,
    visible_after: int = 0,
    delay: str = "5 seconds",
    clock: str | None = None,
) -> DataFrame:
    """Every attempt with ``status``, ``hot`` and its ad's owner and target; append mode.

    ``ads`` is the catalogue when the job first starts; ``changes`` a stream of later versions of
    its rows. Both are whole rows; the newest at the time of an attempt holds, if it has come by
    the time the attempt is answered: when the watermark, ``delay`` behind the clock, has passed the
    second the attempt lies in. All attempts of one ad in a micro-batch meet in one task: bound it
    with ``maxOffsetsPerTrigger``.
    """
    checked = validate_attempts(stateful.on_clock(attempts, "attempted_at", delay, clock))
    valid = checked.where(F.size("broken_rules") == 0).drop("broken_rules")
    labelled = stateful.stream_statuses(
        valid, ttl_seconds, keep_state_seconds, step_ms=1000 * rules.resolution
    )
    rows = labelled.select(
        "click_id",
        "ad_id",
        "user_id",
        F.unix_micros("attempted_at").alias("t"),
        F.xxhash64("click_id").alias("tie"),
        "status",
        F.lit(None).cast("long").alias("advertiser_id"),
        F.lit(None).cast("string").alias("redirect_url"),
        F.lit(None).cast("boolean").alias("active"),
        F.lit(False).alias("version"),
    )
    if changes is not None:
        # No watermark of its own: a catalogue that does not change must not hold the clicks up.
        rows = rows.unionByName(_as_versions(changes))
    shard = F.pmod(F.xxhash64("ad_id"), F.lit(stateful.SHARDS)).alias("_shard")
    start = ads.select(F.col("id").alias("ad_id"), "advertiser_id", "redirect_url", "active")
    # A row for each shard: a large catalogue is not taken in ad by ad.
    kept = F.collect_list(F.struct(*stateful.TagProcessor.CATALOGUE)).alias("ads")
    start = start.where("ad_id IS NOT NULL").groupBy(shard).agg(kept).select(
        "_shard", *(F.col(f"ads.{name}").alias(name) for name in stateful.TagProcessor.CATALOGUE)
    )
    tagged = rows.select("*", shard).groupBy("_shard").transformWithState(
        stateful.TagProcessor(rules, visible_after, list(_COLUMNS)),
        _OUTCOMES,
        "append",
        "EventTime",
        start.groupBy("_shard"),
    )
    outcomes = tagged.select(
        "click_id",
        "ad_id",
        "advertiser_id",
        "redirect_url",
        "user_id",
        F.timestamp_micros("t").alias("clicked_at"),
        "status",
        "hot",
    )
    broken = checked.where(F.size("broken_rules") > 0).select(
        "click_id",
        "ad_id",
        F.lit(None).cast("long").alias("advertiser_id"),
        F.lit(None).cast("string").alias("redirect_url"),
        "user_id",
        F.col("attempted_at").alias("clicked_at"),
        F.lit("invalid").alias("status"),
        F.lit(False).alias("hot"),
        "broken_rules",
    )
    return outcomes.withColumn("broken_rules", F.lit(None).cast("array<string>")).unionByName(broken)


def start_accepting(
    outcomes: DataFrame,
    path: str,
    checkpoint: str,
    salting: bool = True,
    receiver: str = "spark",
    publish: Callable[[DataFrame], None] | None = None,
    trigger_seconds: int = 1,
    available_now: bool = False,
) -> StreamingQuery:
    """Write :func:`stream_outcomes` to the log at ``path``: ``outcomes`` of valid attempts,
    ``records`` for the topic, and ``rejects`` with the rules they break.

    The three become visible in one commit, once, also when a batch is run again. ``publish``
    (``sources.clicks.write_topic``) sends the records on first; a topic may see some twice.
    """
    log = VersionedLog(outcomes.sparkSession, path)

    def sink(batch: DataFrame, batch_id: int) -> None:
        if log.committed(batch_id):
            log.pass_over(batch)
            return
        batch = batch.persist()
        try:
            valid = batch.where("status <> 'invalid'").drop("broken_rules")
            accepted = valid.where("status = 'accepted'").withColumn("receiver", F.lit(receiver))
            records = encode_events(assign_salt(accepted, salting), salting)
            if publish is not None:
                publish(records)
            rejects = batch.where("status = 'invalid'").select(
                "click_id", "ad_id", "user_id", "clicked_at", "broken_rules"
            )
            log.commit(batch_id, {"outcomes": valid, "records": records, "rejects": rejects})
        finally:
            batch.unpersist()

    trigger = {"availableNow": True} if available_now else {"processingTime": f"{trigger_seconds} seconds"}
    return (
        outcomes.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(sink)
        .start()
    )
