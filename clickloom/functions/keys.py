"""Salts, partition keys and a model of the topic's partitioner."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
SALT_BUCKETS = 12
TOPIC_PARTITIONS = 12


def salt_for(click_id: Column, hot: Column, salting: bool = True, buckets: int = SALT_BUCKETS) -> Column:
    """0 for normal ads; for hot ads an even spread over ``buckets``.

    The salt is a hash of the click id, so that a replay assigns the same one.
    """
    if not salting:
        return F.lit(0)
    digest = F.conv(F.substring(F.md5(click_id), 1, 8), 16, 10).cast("long")
    return F.when(hot, F.pmod(digest, F.lit(buckets)).cast("int")).otherwise(F.lit(0))


def partition_key(ad_id: Column, salt: Column, hot: Column, salting: bool = True) -> Column:
    """``ad#salt`` for hot ads while salting is on, else ``ad``."""
    ad = ad_id.cast("string")
    if not salting:
        return ad
    return F.when(hot, F.concat_ws("#", ad, salt.cast("string"))).otherwise(ad)


def topic_partition(key: Column, partitions: int = TOPIC_PARTITIONS) -> Column:
    """A model: CRC32 of the key modulo the partition count."""
    return F.pmod(F.crc32(key), F.lit(partitions)).cast("int")
