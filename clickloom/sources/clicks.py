"""The click topic: JSON records in and out, from Kafka or from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clickloom.functions.keys import partition_key, salt_for
from clickloom.functions.timebuckets import rfc3339_ms
from clickloom.schemas import CLICK_EVENT


# ISO 8601 with a zone; a time without one names no instant.
ZONED_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"
_TEXT_EVENT = StructType(
    [
        StructField(field.name, StringType() if field.name == "clicked_at" else field.dataType)
        for field in CLICK_EVENT
    ]
)


def parse_clicks(records: DataFrame, value: str = "value") -> DataFrame:
    """Decode JSON leniently: a bad record or field becomes null, never a failure."""
    kept = [name for name in records.columns if name != value]
    event = F.from_json(F.col(value).cast("string"), _TEXT_EVENT, {"mode": "PERMISSIVE"})
    when = F.col("clicked_at")
    return (
        records.select(*kept, event.alias("event"))
        .select(*kept, "event.*")
        .withColumn("clicked_at", F.when(when.rlike(ZONED_TIME), when.try_cast("timestamp")))
    )


def read_topic(
    spark: SparkSession,
    servers: str,
    topic: str = "clicks",
    max_offsets_per_trigger: int | None = None,
    streaming: bool = True,
    **options: str,
) -> DataFrame:
    """The topic's ``value`` column. Offsets live in the checkpoint; a first start is from earliest.

    Needs the Kafka connector on the class path.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = (
        reader.option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
    )
    if streaming and max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load().select("value")


def read_click_files(
    spark: SparkSession, path: str, streaming: bool = True, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The same records as JSON lines in a folder."""
    if not streaming:
        return spark.read.text(path)
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path)


def assign_salt(clicks: DataFrame, salting: bool = True, buckets: int = 12) -> DataFrame:
    """Add ``salt`` to clicks carrying ``click_id`` and ``hot``."""
    return clicks.withColumn("salt", salt_for(F.col("click_id"), F.col("hot"), salting, buckets))


def event_json() -> Column:
    """A click as the topic's JSON, its time cut to the millisecond."""
    return F.to_json(
        F.struct(
            "click_id",
            "ad_id",
            "advertiser_id",
            "salt",
            "user_id",
            rfc3339_ms(F.col("clicked_at")).alias("clicked_at"),
            "receiver",
        )
    )


def encode_events(clicks: DataFrame, salting: bool = True) -> DataFrame:
    """Accepted clicks as ``(key, value)`` records; needs ``salt`` and ``hot``."""
    return clicks.select(
        partition_key(F.col("ad_id"), F.col("salt"), F.col("hot"), salting).alias("key"),
        event_json().alias("value"),
    )


def write_topic(records: DataFrame, servers: str, topic: str = "clicks") -> None:
    """Append ``(key, value)`` records to the topic (Kafka connector needed)."""
    (
        records.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("kafka.acks", "all")
        .option("kafka.enable.idempotence", "true")
        .save()
    )


def write_click_files(records: DataFrame, path: str) -> None:
    records.select("value").write.mode("append").text(path)
