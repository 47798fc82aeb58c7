"""Which clicks count: malformed and late records, strict validation, attempt checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.rules import attempt_rules, event_fields, event_rules, typed_event

# Fixed values.
REQUIRED = ("ad_id", "advertiser_id", "salt", "clicked_at")
LATE_CUTOFF_MS = 3_600_000


def as_of_column(as_of: datetime | Column | None) -> Column:
    """The clock: a fixed time in batch, the micro-batch's time when ``None``."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def is_malformed() -> Column:
    verdict = F.lit(False)
    for name in REQUIRED:
        verdict = verdict | F.col(name).isNull()
    return verdict


def is_late(as_of: datetime | Column | None, cutoff_ms: int = LATE_CUTOFF_MS) -> Column:
    """Strictly older than the cutoff, in whole milliseconds; future clicks are not late."""
    age = F.unix_millis(as_of_column(as_of)) - F.unix_millis("clicked_at")
    return age > F.lit(cutoff_ms)


def disposition(as_of: datetime | Column | None, cutoff_ms: int | None = LATE_CUTOFF_MS) -> Column:
    """``malformed``, ``late`` or ``kept``; malformed is tested first. No cutoff: nothing is late."""
    label = F.when(is_malformed(), "malformed")
    if cutoff_ms is not None:
        label = label.when(is_late(as_of, cutoff_ms), "late")
    return label.otherwise("kept")


def keep_click(
    clicks: DataFrame, as_of: datetime | Column | None, cutoff_ms: int | None = LATE_CUTOFF_MS
) -> DataFrame:
    kept = clicks.where(~is_malformed())
    return kept if cutoff_ms is None else kept.where(~is_late(as_of, cutoff_ms))


def drop_counters(
    clicks: DataFrame, as_of: datetime | Column | None, cutoff_ms: int | None = LATE_CUTOFF_MS
) -> DataFrame:
    """One row with the number of records kept and dropped per reason."""
    label = disposition(as_of, cutoff_ms)
    return clicks.select(label.alias("label")).agg(*drop_metrics(F.col("label")))


def drop_metrics(label: Column) -> list[Column]:
    return [
        F.count_if(label == "late").alias("dropped_late"),
        F.count_if(label == "malformed").alias("dropped_malformed"),
        F.count_if(label == "kept").alias("kept"),
    ]


def validate_events(records: DataFrame, value: str = "value") -> DataFrame:
    """Add ``broken_rules``: empty for a strictly valid event."""
    typed = records.withColumn("_fields", event_fields(F.col(value))).withColumn(
        "_event", typed_event(F.col("_fields"))
    )
    return typed.withColumn("broken_rules", event_rules(F.col("_event"))).drop("_fields", "_event")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows of anything carrying ``broken_rules``."""
    valid = F.size("broken_rules") == 0
    return validated.where(valid).drop("broken_rules"), validated.where(~valid)


def validate_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("broken_rules", attempt_rules(F.col("ad_id"), F.col("user_id")))
