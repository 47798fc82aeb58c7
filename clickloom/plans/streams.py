"""The streaming jobs as queries: the events arrive in three steps, the job restarts at each."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators.hot import HotRules
from clickloom.plans import inputs
from clickloom.plans import queries as registry
from clickloom.plans.queries import HOT_RULES, counts_sql, hot_markings_sql, query, walk_sql
from clickloom.session import scratch_path
from clickloom.streaming import accept, counts, durable, ingest, sinks, stateful
from clickloom.streaming.log import VersionedLog

# Where the month of events is cut.
CUTS = ("2024-01-08", "2024-01-20")
DAY_MS = 86_400_000
CUTOFF_DAYS = 20


def arrive(spark: SparkSession, sf_dir: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Append the events in time order, running the job to the end of what has arrived."""
    events = inputs.table(spark, sf_dir, "events")
    folder = scratch_path(spark, "arrivals")
    bounds = [None, *CUTS, None]
    for low, high in zip(bounds, bounds[1:]):
        step = events
        if low is not None:
            step = step.where(F.col("ts") >= F.lit(low).cast("timestamp_ntz"))
        if high is not None:
            step = step.where(F.col("ts") < F.lit(high).cast("timestamp_ntz"))
        step.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        start(stream).awaitTermination()


# Arrivals out of order: up to so late, and some long before their own time.
LATEST = "20 hours"
AHEAD = "2 days"
DELAY = "21 hours"


def arrive_disordered(
    spark: SparkSession, sf_dir: str, start: Callable[[DataFrame], StreamingQuery]
) -> None:
    """As :func:`arrive`, but by ``arrived_at``: every event is late by its own hash, one in forty
    is dated ahead. A last row without an event lets the clock go on."""
    events = inputs.table(spark, sf_dir, "events")
    spread = F.pmod(F.xxhash64("event_id"), F.lit(72_000))
    late = F.col("ts").cast("timestamp") + F.make_dt_interval(secs=spread)
    early = F.col("ts").cast("timestamp") - F.expr(f"INTERVAL {AHEAD}")
    arrived = F.when(spread % 40 == 0, early).otherwise(late)
    events = events.withColumn("arrived_at", arrived)
    folder = scratch_path(spark, "arrivals")
    bounds = [None, *(F.lit(cut).cast("timestamp") for cut in CUTS), None]
    for low, high in zip(bounds, bounds[1:]):
        step = events
        if low is not None:
            step = step.where(F.col("arrived_at") >= low)
        if high is not None:
            step = step.where(F.col("arrived_at") < high)
        if high is None:
            over = F.lit("2024-12-31 00:00:00").cast("timestamp")
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema[:-1]]
            step = step.unionByName(spark.range(1).select(*nothing, over.alias("arrived_at")))
        step.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        start(stream).awaitTermination()


@query(
    "stream_minute_counts",
    f"""
SELECT ad_id, advertiser_id, minute, click_count FROM ({counts_sql(f'''
  SELECT * FROM ({inputs.clicks_sql(nulls=True)}) WHERE salt IS NOT NULL
  AND epoch_ms(TIMESTAMP '{inputs.AS_OF}') - epoch_ms(clicked_at) <= {CUTOFF_DAYS * DAY_MS}''')})
""",
)
def _stream_minute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "checkpoint")
    config = counts.CountingConfig(cutoff_ms=CUTOFF_DAYS * DAY_MS, state_ttl_ms=(CUTOFF_DAYS + 1) * DAY_MS)

    def start(events: DataFrame) -> StreamingQuery:
        return counts.start_counting(
            inputs.clicks_of(events, nulls=True),
            log,
            checkpoint,
            config=config,
            as_of=F.lit(inputs.AS_OF).cast("timestamp"),
            available_now=True,
        )

    arrive(spark, sf_dir, start)
    return counts.current_counts(counts.read_versions(spark, log)).drop("updated_at")


@query(
    "stream_lost_checkpoint",
    f"""
SELECT ad_id, advertiser_id, minute, click_count FROM ({counts_sql(f'''
  SELECT * FROM ({inputs.clicks_sql(nulls=True)}) WHERE salt IS NOT NULL AND clicked_at IS NOT NULL''')})
""",
)
def _stream_lost_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a job that loses its checkpoint after the first third, and whose closed days are
    compacted in between: those of a recount. The clock goes on with the arrivals, so that none is late."""
    path = scratch_path(spark, "durable")
    lost, kept = scratch_path(spark, "checkpoint"), scratch_path(spark, "checkpoint")
    checkpoints = iter([lost, kept, kept])
    clocks = [datetime.fromisoformat(at) for at in (*CUTS, inputs.AS_OF)]
    cutoff_ms = CUTOFF_DAYS * DAY_MS
    # The first start finds all that is older, and reaches back to it.
    first = F.unix_millis(F.lit(CUTS[0]).cast("timestamp"))
    backlog = first - F.unix_millis(F.min(F.col("ts").cast("timestamp")))
    oldest = inputs.table(spark, sf_dir, "events").agg(backlog).first()[0] or 0
    starts = iter(zip(clocks, [max(cutoff_ms, oldest), cutoff_ms, cutoff_ms]))
    log = VersionedLog(spark, path)

    def close(clock: datetime) -> None:
        # The days that no click in time can fall on any more, as the job has it.
        durable.close_days(log, (clock - timedelta(days=CUTOFF_DAYS)).date())

    def start(events: DataFrame) -> StreamingQuery:
        clock, reach = next(starts)
        close(clock)
        clicks = inputs.clicks_of(events, "sparse", True, "event_id").withColumns(
            {
                "partition": F.pmod(F.col("event_id"), F.lit(7)),
                # Arrivals go by time, and so do places in the topic.
                "offset": F.unix_micros("clicked_at"),
            }
        )
        return durable.start_durable_counts(
            clicks,
            path,
            next(checkpoints),
            counts.CountingConfig(cutoff_ms=reach, state_ttl_ms=reach + DAY_MS),
            as_of=F.lit(clock.isoformat()).cast("timestamp"),
            available_now=True,
        )

    arrive(spark, sf_dir, start)
    close(clocks[-1])
    return durable.current_counts(log).drop("updated_at")


def _logged(
    spark: SparkSession,
    sf_dir: str,
    job: Callable[[DataFrame], DataFrame],
    arrivals: Callable[..., None] = arrive,
) -> DataFrame:
    log, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "checkpoint")

    def start(events: DataFrame) -> StreamingQuery:
        return sinks.start_log(job(events), log, checkpoint, "append", available_now=True)

    arrivals(spark, sf_dir, start)
    return spark.read.parquet(log).drop("batch_id")


@query("stream_dedup", walk_sql("dense", 86_400))
def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def job(events: DataFrame) -> DataFrame:
        return stateful.stream_dedup(inputs.attempts_of(events, "dense"), 86_400, 864_000)

    return _logged(spark, sf_dir, job)


@query("stream_hot", hot_markings_sql())
def _stream_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules: HotRules = HOT_RULES

    def job(events: DataFrame) -> DataFrame:
        return stateful.stream_hot(inputs.clicks_of(events, "dense"), rules)

    return stateful.latest_markings(_logged(spark, sf_dir, job), rules)


@query("stream_dedup_disorder", walk_sql("dense", 86_400))
def _stream_dedup_disorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of attempts that come late, early and in any order: those of the batch."""

    def job(events: DataFrame) -> DataFrame:
        attempts = inputs.attempts_of(events, "dense", "arrived_at")
        return stateful.stream_dedup(
            attempts, 86_400, 864_000, delay=DELAY, clock="arrived_at", in_order=True
        )

    return _logged(spark, sf_dir, job, arrive_disordered)


@query("stream_hot_disorder", hot_markings_sql())
def _stream_hot_disorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markings from clicks that come late, early and in any order: those of the batch."""
    rules: HotRules = HOT_RULES

    def job(events: DataFrame) -> DataFrame:
        clicks = inputs.clicks_of(events, "dense", False, "arrived_at")
        return stateful.stream_hot(clicks, rules, delay=DELAY, clock="arrived_at", in_order=True)

    return stateful.latest_markings(_logged(spark, sf_dir, job, arrive_disordered), rules)


def _accepting(spark: SparkSession, sf_dir: str) -> VersionedLog:
    """The log of the accepting job over disordered arrivals and two restarts."""
    path, checkpoint = scratch_path(spark, "accepted"), scratch_path(spark, "checkpoint")
    ads = inputs.ads(spark, sf_dir)

    def start(events: DataFrame) -> StreamingQuery:
        outcomes = accept.stream_outcomes(
            inputs.attempts_of(events, "sparse", "arrived_at"),
            ads,
            rules=registry.SPARSE_RULES,
            ttl_seconds=registry.SPARSE_TTL,
            keep_state_seconds=10 * registry.SPARSE_TTL,
            delay=DELAY,
            clock="arrived_at",
        )
        return accept.start_accepting(outcomes, path, checkpoint, available_now=True)

    arrive_disordered(spark, sf_dir, start)
    return VersionedLog(spark, path)


@query("stream_accepted_events", registry.ORACLES["accepted_events"])
def _stream_accepted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt to event in one job: the records of the batch."""
    return _accepting(spark, sf_dir).read("records", "key string, value string")


@query("stream_attempt_outcomes", registry.ORACLES["attempt_outcomes"])
def _stream_attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status and the hot tag of every attempt, from the same job."""
    return _accepting(spark, sf_dir).read(
        "outcomes",
        "click_id string, ad_id long, advertiser_id long, user_id string, clicked_at timestamp,"
        " status string, hot boolean",
    )


@query("stream_dead_letters", registry.ORACLES["validate_events"])
def _stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good records and rejects of a job that starts three times: every record once, with the rules
    it breaks."""
    path, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "checkpoint")
    folder = scratch_path(spark, "records")
    records = registry.event_records(spark, sf_dir)
    third = F.pmod(F.xxhash64("record_id"), F.lit(3))
    for step in range(3):
        records.where(third == step).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(records.schema).parquet(folder)
        ingest.start_ingest(stream, path, checkpoint, available_now=True).awaitTermination()
    log = VersionedLog(spark, path)
    good = log.read(ingest.EVENTS, "record_id string").withColumn("broken_rules", F.lit(""))
    bad = log.read(ingest.REJECTS, "record_id string, broken_rules array<string>")
    return good.unionByName(bad.withColumn("broken_rules", F.array_join("broken_rules", ",")))
