"""Catalogue and count tables, from Parquet or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from clickloom.schemas import ADS, ADVERTISERS, CLICK_COUNTS, COUNTS_BY_DAY


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_ads(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, ADS)


def read_advertisers(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, ADVERTISERS)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts written by :func:`write_counts`; a range on ``day`` prunes partitions."""
    return _read(spark, path, COUNTS_BY_DAY)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A table over JDBC, split on ``partition_column`` so that no single task reads it all."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(bounds[0]))
            .option("upperBound", str(bounds[1]))
            .option("numPartitions", partitions)
        )
    return reader.load()


def write_counts(counts: DataFrame, path: str, files_per_day: int = 16, mode: str = "overwrite") -> None:
    """One folder per UTC day, rows sorted so that an owner and time range skips row groups.

    A day is spread over ``files_per_day`` tasks by ad, so that no day is written by one task.
    """
    (
        counts.select(*CLICK_COUNTS.names)
        .withColumn("day", F.to_date("minute"))
        .withColumn("_part", F.pmod(F.xxhash64("ad_id", "minute"), F.lit(files_per_day)))
        .repartition("day", "_part")
        .sortWithinPartitions("day", "advertiser_id", "minute")
        .drop("_part")
        .write.mode(mode)
        .partitionBy("day")
        .parquet(path)
    )


def merge_counts(changed: DataFrame, table: str) -> None:
    """Upsert absolute counts into a catalogue table whose format supports MERGE."""
    newer = changed.alias("new")
    same_key = (F.col(f"{table}.ad_id") == F.col("new.ad_id")) & (
        F.col(f"{table}.minute") == F.col("new.minute")
    )
    newer.mergeInto(table, same_key).whenMatched().updateAll().whenNotMatched().insertAll().merge()
