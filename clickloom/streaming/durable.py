"""Counting that outlives its checkpoint.

The job keeps the clicks of every (ad, minute) as state, an hour of an ad together, and commits, with each batch's absolute
counts, how far it has read each partition of the source. A job whose checkpoint is lost starts a new
run: its state is seeded from the counts in the log, and records up to the places in the log are
passed over. So a minute goes on from where it was, and none is counted twice.

Records carry ``partition`` and ``offset``, as a topic gives them; offsets grow within a partition.
"""

from __future__ import annotations

import sys
import uuid
from collections import defaultdict
from collections.abc import Iterator
from datetime import date, datetime

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from clickloom.operators.counting import upsert_latest
from clickloom.operators.filtering import as_of_column, disposition, drop_metrics
from clickloom.schemas import CLICK_COUNTS, COUNT_VERSIONS
from clickloom.session import configure
from clickloom.sources.tables import read_counts, write_counts
from clickloom.streaming.counts import DROP_COUNTERS, CountingConfig
from clickloom.streaming.log import VersionedLog
from clickloom.streaming.stateful import _state_settings, on_clock

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PARTIAL = "ad_id long, hour long, minute long, advertiser_id long, n long, partition long, offset long"
_CHANGED = (
    "ad_id long, minute long, advertiser_id long, click_count long,"
    " ends array<struct<partition: bigint, offset: bigint>>"
)
_ENDS = "partition long, offset long, run_seq long"


class MinuteProcessor(StatefulProcessor):
    """The clicks of one ad and hour by minute (in epoch seconds), kept until no click can be in time.

    The minutes of an hour, at most sixty, are read together and have one timer.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "minute long", "advertiser_id long, n long")

    def _wake(self, hour: int) -> None:
        self.handle.registerTimer((hour + 3600) * 1000 + self.keep_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for minute, *count in zip(initialState.minute, initialState.owner, initialState.n):
            self.counts.updateValue((minute,), tuple(count))
        self._wake(key[1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        minutes = {minute[0]: tuple(count) for minute, count in self.counts.iterator()}
        ends: dict[int, dict[int, int]] = defaultdict(dict)
        for row in rows:
            owner, total = minutes.get(row.minute, (row.advertiser_id, 0))
            minutes[row.minute] = (max(owner, row.advertiser_id), total + row.n)
            read = ends[row.minute]
            read[row.partition] = max(read.get(row.partition, -1), row.offset)
        for minute in ends:
            self.counts.updateValue((minute,), minutes[minute])
        self._wake(key[1])
        for minute, read in ends.items():
            yield Row(
                ad_id=key[0],
                minute=minute,
                advertiser_id=minutes[minute][0],
                click_count=minutes[minute][1],
                ends=[Row(partition=p, offset=o) for p, o in sorted(read.items())],
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        groups = batch.groupby(["ad_id", "hour", "minute", "partition"], as_index=False)
        summed = groups.agg(
            advertiser_id=("advertiser_id", "max"), n=("offset", "size"), offset=("offset", "max")
        )
        yield summed[["ad_id", "hour", "minute", "advertiser_id", "n", "partition", "offset"]]


def _hour(minute: Column) -> Column:
    return minute - F.pmod(minute, F.lit(3600))


def read_places(log: VersionedLog, before_run: int) -> dict[int, int]:
    """How far the runs before one have read each partition: a row for each partition."""
    ends = log.read("ends", _ENDS).where(F.col("run_seq") < before_run)
    return {r.partition: r.offset for r in ends.groupBy("partition").agg(F.max("offset").alias("offset")).collect()}


def current_counts(log: VersionedLog) -> DataFrame:
    """The counts as of the commits: closed days as stored, and the newest version of the rest."""
    versions = log.read("counts", COUNT_VERSIONS)
    latest = upsert_latest(versions).select(*CLICK_COUNTS.names)
    closed = [read_counts(log.spark, folder) for folder in log.folders("days")]
    for days in closed:
        # A click for a closed day is late and dropped; only a repair writes there again.
        kept = days.select(*CLICK_COUNTS.names).join(versions, ["ad_id", "minute"], "left_anti")
        latest = latest.unionByName(kept)
    return latest


def close_days(log: VersionedLog, before: date, files_per_day: int = 16) -> None:
    """Compaction in one commit: days before ``before`` go to the layout of stored counts, a folder
    for each day and written once; of the rest one version stays. Readers see all of it or none.

    Choose ``before`` so that no click of such a day is in time any more.
    """
    covered = log.last_batches()
    if not covered:
        return
    spark, folder = log.spark, f"{log.path}/data/{uuid.uuid4().hex}"
    run = max(covered)
    latest = upsert_latest(log.read("counts", COUNT_VERSIONS)).select(*CLICK_COUNTS.names)
    is_closed = F.to_date("minute") < F.lit(before)
    write_counts(latest.where(is_closed), f"{folder}/days", files_per_day)
    left = latest.where(~is_closed).withColumns(
        {"run_seq": F.lit(run).cast("long"), "batch_id": F.lit(covered[run]).cast("long")}
    )
    left.select(*COUNT_VERSIONS.names).write.parquet(f"{folder}/counts")
    ends = log.read("ends", _ENDS).groupBy("partition", "run_seq").agg(F.max("offset").alias("offset"))
    ends.select("partition", "offset", "run_seq").write.parquet(f"{folder}/ends")
    log.merge(
        covered,
        {
            "counts": [f"{folder}/counts"],
            "ends": [f"{folder}/ends"],
            "days": [*log.folders("days"), f"{folder}/days"],
        },
    )


def start_durable_counts(
    clicks: DataFrame,
    path: str,
    checkpoint: str,
    config: CountingConfig = CountingConfig(),
    as_of: datetime | Column | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Count a stream of clicks with ``partition`` and ``offset`` into the log at ``path``.

    A checkpoint that the log does not know is a new run, seeded as above; the source is then read
    from its beginning or, by its ``startingOffsets``, from :func:`read_places`. Minutes leave the
    seed ``state_ttl_ms`` after their end, the state as long after their hour's end; what is later than the cutoff is dropped.
    """
    if config.cutoff_ms is None:
        raise ValueError("state that expires needs a cutoff")
    spark: SparkSession = configure(clicks.sparkSession)
    _state_settings(clicks)
    log = VersionedLog(spark, path, config.files_per_batch)
    run = log.run_of(checkpoint)
    places = read_places(log, run)
    now = as_of_column(as_of)

    fresh = clicks
    if places:
        pairs = [F.lit(item) for place in places.items() for item in place]
        done = F.coalesce(F.create_map(*pairs)[F.col("partition")], F.lit(-1))
        fresh = clicks.where(F.col("offset") > done)
    labelled = fresh.withColumn("label", disposition(now, config.cutoff_ms)).observe(
        DROP_COUNTERS, *drop_metrics(F.col("label"))
    )
    timed = on_clock(labelled.where("label = 'kept'").withColumn("_now", now), "clicked_at", "0 seconds", "_now")
    minute = F.unix_seconds(F.date_trunc("minute", "clicked_at"))
    partial = timed.select(
        "ad_id",
        _hour(minute).alias("hour"),
        minute.alias("minute"),
        "advertiser_id",
        F.col("partition").cast("long").alias("partition"),
        F.col("offset").cast("long").alias("offset"),
    ).mapInPandas(_partial, _PARTIAL)

    seed = None
    if run > 0:
        held = upsert_latest(log.read("counts", COUNT_VERSIONS).where(F.col("run_seq") < run))
        seconds = F.unix_seconds("minute")
        alive = (seconds + 60) * 1000 + config.state_ttl_ms >= F.unix_millis(now)
        minutes = F.collect_list(F.struct(seconds.alias("minute"), "advertiser_id", "click_count"))
        alive_counts = held.where(alive).groupBy("ad_id", _hour(seconds).alias("hour"))
        names = {"minute": "minute", "advertiser_id": "owner", "click_count": "n"}
        lists = [F.col(f"m.{old}").alias(new) for old, new in names.items()]
        seed = alive_counts.agg(minutes.alias("m")).select("ad_id", "hour", *lists).groupBy("ad_id", "hour")
    changed = partial.groupBy("ad_id", "hour").transformWithState(
        MinuteProcessor(config.state_ttl_ms), _CHANGED, "update", "EventTime", seed
    )

    def sink(batch: DataFrame, batch_id: int) -> None:
        if log.committed(batch_id, run):
            log.pass_over(batch)
            return
        batch = batch.persist()
        try:
            counts = batch.select(
                "ad_id",
                "advertiser_id",
                F.timestamp_seconds("minute").alias("minute"),
                "click_count",
                F.current_timestamp().alias("updated_at"),
                F.lit(run).cast("long").alias("run_seq"),
                F.lit(batch_id).cast("long").alias("batch_id"),
            )
            ends = (
                batch.select(F.explode("ends").alias("end"))
                .groupBy("end.partition")
                .agg(F.max("end.offset").alias("offset"))
                .withColumn("run_seq", F.lit(run).cast("long"))
            )
            log.commit(batch_id, {"counts": counts, "ends": ends}, run)
        finally:
            batch.unpersist()

    trigger = (
        {"availableNow": True} if available_now else {"processingTime": f"{config.trigger_seconds} seconds"}
    )
    return (
        changed.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(sink)
        .start()
    )
