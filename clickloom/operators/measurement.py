"""Judging a run: reconciliation, latency timelines, gates, partition skew, freshness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.keys import TOPIC_PARTITIONS, topic_partition
from clickloom.functions.timebuckets import floor_div, floor_to, minute_floor
from clickloom.operators.percentiles import percentiles, values_at_ranks, nearest_rank
from clickloom.sources.samples import select_series

# Fixed values.
OK_STATUS = "302"
DEGRADED_P95_MS = 100.0


# -- reconciliation ---------------------------------------------------------------------------


def expected_from_series(accepted: DataFrame, label: str = "advertiser") -> DataFrame:
    """Accepted clicks per advertiser, summed over the series whose label is a number."""
    return (
        accepted.groupBy(F.col("labels")[label].try_cast("long").alias("advertiser_id"))
        .agg(F.sum("value").cast("long").alias("accepted"))
        .where(F.col("advertiser_id").isNotNull())
    )


def last_sample(series: DataFrame) -> DataFrame:
    return series.agg(F.max("ts").alias("last_sample_at"))


def reconcile(expected: DataFrame, counts: DataFrame) -> DataFrame:
    """Accepted against counted clicks per expected advertiser; nothing counted is 0."""
    counted = counts.groupBy("advertiser_id").agg(F.sum("click_count").alias("counted"))
    got = F.coalesce(F.col("counted"), F.lit(0).cast("long"))
    return expected.join(counted, "advertiser_id", "left").select(
        "advertiser_id", "accepted", got.alias("counted"), (got - F.col("accepted")).alias("diff")
    )


def reconcile_verdict(reconciled: DataFrame, ambiguous: int | Column) -> DataFrame:
    """Passes when nothing is lost and no more is over-counted than had an unknown outcome.

    A run that expected no advertiser at all has shown nothing, and fails.
    """
    zero = F.lit(0).cast("long")
    unknown = ambiguous if isinstance(ambiguous, Column) else F.lit(ambiguous).cast("long")
    return (
        reconciled.agg(
            F.coalesce(F.sum(F.greatest(-F.col("diff"), zero)), zero).alias("lost"),
            F.coalesce(F.sum(F.greatest(F.col("diff"), zero)), zero).alias("over"),
            F.count_if(F.col("diff") != 0).alias("mismatched"),
            F.count(F.lit(1)).alias("expected"),
        )
        .withColumn("ambiguous", unknown)
        .withColumn(
            "pass",
            (F.col("expected") > 0) & (F.col("lost") == 0) & (F.col("over") <= F.col("ambiguous")),
        )
        .drop("expected")
    )


# The metrics of a load run.
ACCEPTED_METRIC = "clicks_accepted_adv"
UNKNOWN_METRICS = ("clicks_503", "clicks_other")


def reconcile_run(
    series: DataFrame, counts: DataFrame, run: str, stretch: str = "30 minutes"
) -> DataFrame:
    """The verdict on one run, all of it from the run's own series.

    What it expects is its accepted clicks; what may come on top are its answers of unknown outcome;
    and the clicks counted are those since ``stretch`` before its last sample, in whole hours. The
    bound is worked out first, by a subquery, and reaches the scan of the counts.
    """
    accepted = select_series(series, ACCEPTED_METRIC, testid=run)
    ended = last_sample(accepted).scalar()
    since = F.date_trunc("hour", ended - F.expr(f"INTERVAL {stretch}"))
    held = counts.where(F.col("minute") >= since)
    if "day" in counts.columns:
        held = held.where(F.col("day") >= F.to_date(since))
    of_run = (F.col("labels")["testid"] == run) & F.col("metric").isin(*UNKNOWN_METRICS)
    unknown = series.where(of_run).agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).cast("long").alias("ambiguous")
    )
    return reconcile_verdict(reconcile(expected_from_series(accepted), held), unknown.scalar())


# -- latency timeline -------------------------------------------------------------------------


def latency_timeline(samples: DataFrame, bucket_seconds: int = 10, ok_status: str = OK_STATUS) -> DataFrame:
    """Requests, errors, latency percentiles and a count per status for each time bucket."""
    start = floor_to(F.col("timestamp"), bucket_seconds)
    bucketed = samples.withColumn("bucket", start)
    latency = percentiles(bucketed, ["bucket"], "metric_value", {"p50": 50, "p95": 95})
    by_status = bucketed.groupBy("bucket", "status").agg(F.count(F.lit(1)).alias("n"))
    # One entry per distinct status of a bucket: the codes a server answers with.
    statuses = by_status.groupBy("bucket").agg(
        F.sum("n").alias("requests"),
        F.coalesce(F.sum(F.when(F.col("status") != ok_status, F.col("n"))), F.lit(0).cast("long")).alias(
            "errors"
        ),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("by_status"),
    )
    return (
        statuses.join(latency.drop("n"), "bucket")
        .withColumn("error_pct", F.lit(100.0) * F.col("errors") / F.col("requests"))
        .select("bucket", "requests", "errors", "error_pct", "p50", "p95", "max", "by_status")
    )


def degraded_window(timeline: DataFrame, bucket_seconds: int = 10) -> DataFrame:
    """From the first to the end of the last bucket with errors or a slow p95; null if none."""
    bad = timeline.where((F.col("errors") > 0) | (F.col("p95") >= DEGRADED_P95_MS))
    return bad.agg(
        F.min("bucket").alias("first_bad"),
        F.max("bucket").alias("last_bad"),
        F.count(F.lit(1)).alias("bad_buckets"),
    ).withColumn("width_seconds", F.col("last_bad") - F.col("first_bad") + F.lit(bucket_seconds))


# -- gates ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Gate:
    """``value`` must lie below (or above) ``limit``; without a limit it is only reported."""

    name: str
    value: str
    digits: int
    limit: float | None = None
    above: bool = False


# The thresholds of each scenario.
_LOAD = [
    Gate("click p95 steady ms", "p95_clicks", 1, 100.0),
    Gate("click p95 burst ms", "p95_clicks_burst", 1, 100.0),
    Gate("click error rate %", "error_pct", 4, 0.1),
    Gate("click 302 rate %", "ok_pct", 4, 99.9, above=True),
    Gate("query p95 ms", "p95_queries", 1, 500.0),
]
GATES = {
    "clicks": _LOAD,
    "hot": [
        *_LOAD,
        Gate("hot ad seen at s", "hot_seen_s", 1, 30.0),
        Gate("partition skew max/min", "partition_skew", 2),
    ],
    "chaos": [
        Gate("click p95 ms", "p95_click", 1),
        Gate("click error rate %", "error_pct", 4, 1.0),
        Gate("click 302 rate %", "ok_pct", 4, 99.0, above=True),
    ],
    "scale": [Gate("click p95 ms", "p95_click", 1), Gate("click error rate %", "error_pct", 4)],
}


def runner_p95(samples: DataFrame) -> DataFrame:
    """The worst runner's p95 (conservative) beside the exact p95 of all samples together."""
    per_runner = percentiles(samples, ["runner"], "metric_value", {"p95": 95})
    worst = per_runner.agg(
        F.count(F.lit(1)).alias("runners"), F.max("p95").alias("max_runner_p95")
    )
    merged = percentiles(samples.withColumn("everyone", F.lit(1)), ["everyone"], "metric_value", {"p95": 95})
    return (
        worst.withColumn("everyone", F.lit(1))
        .join(merged.select("everyone", F.col("p95").alias("merged_p95")), "everyone")
        .drop("everyone")
    )


def _worst_p95(samples: DataFrame) -> DataFrame:
    """Max-of-runners p95 per scenario and per kind, long: ``(measure, value)``."""
    # The query scenario is judged by its queries, the others by their clicks.
    own = samples.where((F.col("scenario") == "queries") == (F.col("kind") == "query"))
    by_scenario = values_at_ranks(own, ["scenario", "runner"], "metric_value", {"p95": nearest_rank(95)})
    by_kind = values_at_ranks(samples, ["kind", "runner"], "metric_value", {"p95": nearest_rank(95)})
    return (
        by_scenario.select(F.concat(F.lit("p95_"), "scenario").alias("measure"), F.col("p95").alias("value"))
        .unionByName(
            by_kind.where("kind = 'click'").select(F.lit("p95_click").alias("measure"), F.col("p95").alias("value"))
        )
        .groupBy("measure")
        .agg(F.max("value").alias("value"))
    )


def _rates(samples: DataFrame, ok_status: str) -> DataFrame:
    """Click error and ok percentages, ``(measure, value)``; no requests means no errors."""
    is_click = F.col("kind") == "click"
    totals = samples.agg(
        F.count_if(is_click).alias("requests"),
        F.count_if(is_click & (F.col("status") != ok_status)).alias("failed"),
    )
    rate = F.when(F.col("requests") > 0, F.col("failed") / F.col("requests")).otherwise(F.lit(0.0))
    return totals.select(
        F.explode(
            F.array(
                F.struct(F.lit("error_pct").alias("measure"), (rate * 100).alias("value")),
                F.struct(F.lit("ok_pct").alias("measure"), ((1 - rate) * 100).alias("value")),
            )
        ).alias("m")
    ).select("m.*")


def hot_seen(tagged: DataFrame, time: str = "clicked_at") -> DataFrame:
    """``(measure, value)`` of the first hot answer any runner got, in seconds from its start."""
    by_runner = tagged.groupBy("runner").agg(
        F.min(time).alias("start"), F.min(F.when(F.col("hot"), F.col(time))).alias("seen")
    )
    waited = (F.unix_micros("seen") - F.unix_micros("start")) / F.lit(1_000_000.0)
    return by_runner.agg(F.min(waited).alias("value")).select(
        F.lit("hot_seen_s").alias("measure"), "value"
    )


def run_gates(
    samples: DataFrame,
    scenario: str,
    measures: DataFrame | None = None,
    ok_status: str = OK_STATUS,
) -> DataFrame:
    """``(gate, value, limit, pass)`` of a scenario; a missing value fails, a report has no verdict.

    ``measures`` adds ``(measure, value)`` rows the samples cannot give, such as
    ``hot_seen_s`` and ``partition_skew``.
    """
    spark = samples.sparkSession
    known = _worst_p95(samples).unionByName(_rates(samples, ok_status))
    if measures is not None:
        known = known.unionByName(measures.select("measure", "value"))
    gates = spark.createDataFrame(
        [(g.name, g.value, g.digits, g.limit, g.above) for g in GATES[scenario]],
        "gate string, measure string, digits int, limit double, above boolean",
    )
    value = F.coalesce(*[F.when(F.col("digits") == d, F.round("value", d)) for d in (1, 2, 4)])
    inside = F.when(F.col("above"), F.col("value") > F.col("limit")).otherwise(
        F.col("value") < F.col("limit")
    )
    return (
        gates.join(known, "measure", "left")
        .withColumn("value", value)
        .select(
            "gate",
            "value",
            "limit",
            F.when(F.col("limit").isNotNull(), F.coalesce(inside, F.lit(False))).alias("pass"),
        )
    )


# -- partitions and freshness -----------------------------------------------------------------


def partition_rates(records: DataFrame, partitions: int = TOPIC_PARTITIONS) -> DataFrame:
    """Records per topic partition, by the partitioner model; an idle partition has none."""
    seen = records.groupBy(topic_partition(F.col("key"), partitions).alias("partition")).agg(
        F.count(F.lit(1)).alias("records")
    )
    kind = seen.schema["partition"].dataType
    every = records.sparkSession.range(partitions).select(F.col("id").cast(kind).alias("partition"))
    return every.join(seen, "partition", "left").withColumn(
        "records", F.coalesce("records", F.lit(0).cast("long"))
    )


def partition_skew(rates: DataFrame) -> DataFrame:
    """Highest over lowest rate among the partitions listed."""
    high, low = F.max("records"), F.min("records")
    return rates.agg(
        F.count(F.lit(1)).alias("partitions"),
        high.alias("most"),
        low.alias("least"),
        (high / F.greatest(low.cast("double"), F.lit(1e-9))).alias("skew"),
    )


def freshness_lag(clicks: DataFrame, counts: DataFrame) -> DataFrame:
    """Longest time from a click to the update that made its minute visible, in seconds."""
    earliest = clicks.groupBy("ad_id", minute_floor(F.col("clicked_at")).alias("minute")).agg(
        F.min("clicked_at").alias("clicked_at")
    )
    lag = (F.unix_micros("updated_at") - F.unix_micros("clicked_at")) / F.lit(1_000_000.0)
    return earliest.join(counts, ["ad_id", "minute"]).agg(F.max(lag).alias("max_lag_seconds"))


def longest_pause(counts: DataFrame) -> DataFrame:
    """The longest time without any update, in seconds.

    Gaps are found inside each hour over distinct update times, then between the hours of a
    year, then between years, so that no window spans the whole table.
    """
    t = F.unix_micros("updated_at")
    pieces = (
        counts.groupBy(t.alias("first"))
        .agg(F.max(t).alias("last"))
        .withColumn("gap", F.lit(None).cast("long"))
    )
    for stretch_seconds in (3600, 366 * 86400, None):
        stretch = (
            F.lit(0).cast("long")
            if stretch_seconds is None
            else floor_div(F.col("first"), stretch_seconds * 1_000_000)
        )
        before = F.lag("last").over(Window.partitionBy("stretch").orderBy("first"))
        pieces = (
            pieces.withColumn("stretch", stretch)
            .withColumn("gap", F.greatest("gap", F.col("first") - before))
            .groupBy("stretch")
            .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("gap").alias("gap"))
            .drop("stretch")
        )
    return pieces.agg((F.max("gap") / F.lit(1_000_000.0)).alias("max_pause_seconds"))


def freshness_gap(clicks: DataFrame, counts: DataFrame) -> DataFrame:
    """Both freshness figures in one row."""
    lag = freshness_lag(clicks, counts).withColumn("one", F.lit(1))
    return lag.join(longest_pause(counts).withColumn("one", F.lit(1)), "one").drop("one")
