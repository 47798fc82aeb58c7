"""The continuous counting job: records in, absolute per-minute counts out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators.counting import newest
from clickloom.operators.filtering import (
    LATE_CUTOFF_MS,
    as_of_column,
    disposition,
    drop_metrics,
)
from clickloom.schemas import VERSION_LOG
from clickloom.session import configure

DROP_COUNTERS = "click_drops"
VALUES = ("advertiser_id", "click_count", "updated_at")


@dataclass(frozen=True)
class CountingConfig:
    """Settings of the job. State must outlive the lateness cutoff, or a late click of an
    expired minute would restart its count and overwrite the larger one."""

    cutoff_ms: int | None = LATE_CUTOFF_MS
    state_ttl_ms: int = 2 * LATE_CUTOFF_MS
    trigger_seconds: int = 1
    files_per_batch: int = 4

    def __post_init__(self) -> None:
        if self.cutoff_ms is not None and self.state_ttl_ms <= self.cutoff_ms:
            raise ValueError("state_ttl_ms must exceed cutoff_ms")


def stream_counts(
    clicks: DataFrame, config: CountingConfig = CountingConfig(), as_of: datetime | Column | None = None
) -> DataFrame:
    """Running clicks per ``(ad_id, minute, part)``, emitted in update mode as they change.

    The watermark only evicts state; it runs on the click time held back to the clock, so that a
    click dated ahead cannot push it past clicks still to come. Such a click is counted for its
    own minute under the ``part`` (the minute by the clock) it arrived in; every other click has
    ``part = minute``. One aggregate is enough: its map-side half reduces a hot ad before the
    shuffle, which is what salting is for.
    """
    now = as_of_column(as_of)
    labelled = clicks.withColumn("label", disposition(now, config.cutoff_ms)).observe(
        DROP_COUNTERS, *drop_metrics(F.col("label"))
    )
    kept = labelled.where("label = 'kept'").select(
        "ad_id",
        "advertiser_id",
        F.date_trunc("minute", "clicked_at").alias("minute"),
        F.least(F.col("clicked_at"), now).alias("seen_at"),
    )
    return (
        kept.withWatermark("seen_at", f"{config.state_ttl_ms} milliseconds")
        .groupBy("ad_id", "minute", F.window("seen_at", "1 minute").alias("w"))
        .agg(F.max("advertiser_id").alias("advertiser_id"), F.count(F.lit(1)).alias("click_count"))
        .select("ad_id", "advertiser_id", "minute", "click_count", F.col("w.start").alias("part"))
    )


def write_versions(changed: DataFrame, path: str, run_seq: int, batch_id: int, files: int = 1) -> None:
    """Record changed counts as one version folder; writing it again replaces it.

    The counts are absolute, so a replayed batch leaves the current table as it was.
    """
    (
        changed.withColumn("updated_at", F.current_timestamp())
        .select("ad_id", "advertiser_id", "minute", "click_count", "updated_at", "part")
        .repartition(files)
        .write.mode("overwrite")
        .parquet(f"{path}/run_seq={run_seq}/batch_id={batch_id}")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def start_counting(
    clicks: DataFrame,
    path: str,
    checkpoint: str,
    run_seq: int = 1,
    config: CountingConfig = CountingConfig(),
    as_of: datetime | Column | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Run the job into the version log at ``path``.

    ``checkpoint`` holds offsets and state and must be kept between restarts. A new checkpoint
    starts with empty state and batch numbers from 0, so it is refused where ``run_seq`` has been
    used: its versions would replace those there. Repair the log with :func:`publish_recount` of
    all raw clicks first, then start with a ``run_seq`` above the recount's; minutes that the new
    run counts replace the recount's, so it must read them from their first click on.
    """
    spark = configure(clicks.sparkSession)
    if _exists(spark, f"{path}/run_seq={run_seq}") and not _exists(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"run_seq {run_seq} has versions in the log but the checkpoint is new")
    trigger = (
        {"availableNow": True} if available_now else {"processingTime": f"{config.trigger_seconds} seconds"}
    )

    def sink(changed: DataFrame, batch_id: int) -> None:
        write_versions(changed, path, run_seq, batch_id, config.files_per_batch)

    return (
        stream_counts(clicks, config, as_of)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(sink)
        .start()
    )


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERSION_LOG).parquet(path)


def current_counts(versions: DataFrame) -> DataFrame:
    """The counts as of the newest versions.

    Per part the last batch wins; a minute's parts add up within a run; and the newest run that
    counted a minute replaces earlier ones.
    """
    parts = versions.groupBy("ad_id", "minute", "run_seq", "part").agg(*newest(F.col("batch_id"), *VALUES))
    # Placed by minute once, which both remaining aggregates can use.
    runs = (
        parts.repartition("ad_id", "minute")
        .groupBy("ad_id", "minute", "run_seq")
        .agg(
            F.max("advertiser_id").alias("advertiser_id"),
            F.sum("click_count").alias("click_count"),
            F.max("updated_at").alias("updated_at"),
        )
    )
    return (
        runs.groupBy("ad_id", "minute")
        .agg(*newest(F.col("run_seq"), *VALUES))
        .select("ad_id", "advertiser_id", "minute", "click_count", "updated_at")
    )


def publish_recount(recounted: DataFrame, path: str, run_seq: int) -> None:
    """Put a batch recount into the log above every earlier run (a repair)."""
    write_versions(recounted.withColumn("part", F.col("minute")), path, run_seq, 0, files=64)


def compact(spark: SparkSession, path: str, target: str, files: int = 64) -> None:
    """Write the log at ``path`` to ``target`` with one version per part, to be read in its place."""
    (
        read_versions(spark, path)
        .groupBy("ad_id", "minute", "run_seq", "part")
        .agg(*newest(F.col("batch_id"), *VALUES), F.max("batch_id").alias("batch_id"))
        .withColumn("_file", F.pmod(F.xxhash64("ad_id", "minute"), F.lit(files)))
        .repartition("run_seq", "_file")
        .drop("_file")
        .write.mode("overwrite")
        .partitionBy("run_seq")
        .parquet(target)
    )
