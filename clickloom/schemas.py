"""Explicit schemas; nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

CLICK_EVENT = T.StructType(
    [
        T.StructField("click_id", T.StringType()),
        T.StructField("ad_id", T.LongType()),
        T.StructField("advertiser_id", T.LongType()),
        T.StructField("salt", T.IntegerType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("clicked_at", T.TimestampType()),
        T.StructField("receiver", T.StringType()),
    ]
)

CLICK_COUNTS = T.StructType(
    [
        T.StructField("ad_id", T.LongType()),
        T.StructField("advertiser_id", T.LongType()),
        T.StructField("minute", T.TimestampType()),
        T.StructField("click_count", T.LongType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

COUNT_VERSIONS = T.StructType(
    [
        *CLICK_COUNTS.fields,
        T.StructField("run_seq", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

VERSION_LOG = T.StructType([*COUNT_VERSIONS.fields, T.StructField("part", T.TimestampType())])

COUNTS_BY_DAY = T.StructType([*CLICK_COUNTS.fields, T.StructField("day", T.DateType())])

ADS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("advertiser_id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("img_url", T.StringType()),
        T.StructField("redirect_url", T.StringType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

ADVERTISERS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

AD_CHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("advertiser_id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("img_url", T.StringType()),
        T.StructField("redirect_url", T.StringType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("changed_at", T.TimestampType()),
    ]
)
