"""Every operator as a query over the given tables, beside the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickloom.functions import timebuckets as tb
from clickloom.functions.spans import Span
from clickloom.operators import (
    catalog,
    counting,
    dedup,
    filtering,
    hot,
    measurement,
    percentiles,
    series,
    sketches,
)
from clickloom.plans import inputs
from clickloom.plans.accept import Accepted, accept
from clickloom.session import scratch_path, stored
from clickloom.sources import clicks as click_source, samples as sample_source
from clickloom.sources.tables import read_counts, write_counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def _utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


def _as_of() -> Column:
    return F.lit(inputs.AS_OF).cast("timestamp")


# The month the events lie in, by hour: 744 buckets.
MONTH = Span.covering("hour", _utc(2024, 1, 1), _utc(2024, 2, 1))
MONTH_BY_DAY = Span.covering("day", MONTH.start, MONTH.end)
# One day by minute: the cap of 1,440 buckets.
ONE_DAY = Span.covering("minute", _utc(2024, 1, 15), _utc(2024, 1, 16))
OWNER = 7
AD = 47

HOT_RULES = hot.HotRules(bucket_seconds=3600, threshold=36, ttl_seconds=36_000, stretch_buckets=48)
HOT_AS_OF = "2024-01-20 12:00:00"
SPARSE_TTL = 86_400


def _with_click_id(clicks: DataFrame, **columns: Column) -> DataFrame:
    return clicks.select("click_id", *[column.alias(name) for name, column in columns.items()])


# -- records in and out -----------------------------------------------------------------------

_CASES = 50


def _case(number: int) -> Column:
    return F.pmod(F.col("click_id").cast("long"), F.lit(_CASES)) == number


def click_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as JSON records, some broken: no JSON, no salt, an offset time, a quoted salt."""
    clicks = inputs.clicks(spark, sf_dir).withColumn("receiver", F.lit("r"))
    base = click_source.event_json()
    no_salt = F.regexp_replace(base, '"salt":[0-9]+,', "")
    quoted = F.regexp_replace(base, '"salt":([0-9]+)', '"salt":"$1"')
    shifted = F.concat(
        F.date_format(F.col("clicked_at") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSS"),
        F.lit("+02:00"),
    )
    moved = F.regexp_replace(
        base, F.lit('"clicked_at":"[^"]*"'), F.concat(F.lit('"clicked_at":"'), shifted, F.lit('"'))
    )
    value = (
        F.when(_case(0), "{not json")
        .when(_case(1), no_salt)
        .when(_case(2), moved)
        .when(_case(3), quoted)
        .otherwise(base)
    )
    return clicks.select(F.col("click_id").alias("record_id"), value.alias("value"))


@query(
    "parse_clicks",
    f"""
SELECT click_id AS record_id,
       CASE WHEN c <> 0 THEN click_id END AS click_id,
       CASE WHEN c <> 0 THEN ad_id END AS ad_id,
       CASE WHEN c <> 0 THEN advertiser_id END AS advertiser_id,
       CASE WHEN c NOT IN (0, 1, 3) THEN salt END AS salt,
       CASE WHEN c <> 0 THEN user_id END AS user_id,
       CASE WHEN c <> 0 THEN date_trunc('millisecond', clicked_at) END AS clicked_at,
       CASE WHEN c <> 0 THEN 'r' END AS receiver
FROM (SELECT *, CAST(click_id AS BIGINT) % {_CASES} AS c FROM ({inputs.clicks_sql()}))
""",
)
def _parse_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_source.parse_clicks(click_records(spark, sf_dir))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as strict events, each case of 50 breaking another rule."""
    digits = F.lpad(F.col("click_id"), 12, "0")
    uuid = F.concat(F.lit("00c0ffee-0000-4000-8000-"), digits)
    clicks = inputs.clicks(spark, sf_dir).select(
        F.col("click_id"),
        F.when(_case(1), F.lit("no-uuid")).otherwise(uuid).alias("uuid"),
        F.when(_case(2), F.lit(0).cast("long")).otherwise(F.col("ad_id")).alias("ad_id"),
        F.when(_case(3), F.lit(-1).cast("long")).otherwise(F.col("advertiser_id")).alias("advertiser_id"),
        F.when(_case(4), F.lit(12)).otherwise(F.col("salt")).alias("salt"),
        F.when(_case(5), F.lit(""))
        .when(_case(6), F.repeat(F.lit("x"), 129))
        .when(_case(7), F.repeat(F.lit("x"), 128))
        .otherwise(F.col("user_id"))
        .alias("user_id"),
        "clicked_at",
        F.lit("r").alias("receiver"),
    )
    when_text = (
        F.when(_case(8), "yesterday")
        .when(_case(9), "2024-13-45T00:00:00Z")
        .otherwise(tb.rfc3339_ms(F.col("clicked_at")))
    )
    base = F.to_json(
        F.struct(
            F.col("uuid").alias("click_id"),
            "ad_id",
            "advertiser_id",
            "salt",
            "user_id",
            when_text.alias("clicked_at"),
            "receiver",
        )
    )
    value = (
        F.when(_case(0), "{not json")
        .when(_case(10), F.regexp_replace(base, '"receiver":"r"', '"receiver":"r","extra":1'))
        .when(_case(11), F.regexp_replace(base, ',"receiver":"r"', ""))
        .when(_case(12), F.regexp_replace(base, '"salt":([0-9]+)', '"salt":"$1"'))
        .when(_case(13), F.regexp_replace(base, '"salt":([0-9]+)', '"salt":$1.5'))
        .when(_case(14), F.lit("[1]"))
        .otherwise(base)
    )
    return clicks.select(F.col("click_id").alias("record_id"), value.alias("value"))


@query(
    "validate_events",
    f"""
SELECT click_id AS record_id,
       CASE CAST(click_id AS BIGINT) % {_CASES}
         WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'click_id' WHEN 2 THEN 'ad_id' WHEN 3 THEN 'advertiser_id'
         WHEN 4 THEN 'salt' WHEN 5 THEN 'user_id' WHEN 6 THEN 'user_id' WHEN 8 THEN 'clicked_at'
         WHEN 9 THEN 'clicked_at' WHEN 10 THEN 'unknown_keys' WHEN 11 THEN 'receiver' WHEN 12 THEN 'salt'
         WHEN 13 THEN 'salt' WHEN 14 THEN 'not_an_object' ELSE '' END AS broken_rules
FROM ({inputs.attempts_sql()})
""",
)
def _validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = filtering.validate_events(event_records(spark, sf_dir))
    return checked.select("record_id", F.array_join("broken_rules", ",").alias("broken_rules"))


@query(
    "validate_attempts",
    f"""
SELECT click_id,
       concat_ws(',', CASE WHEN ad < 1 THEN 'ad_id' END,
                 CASE WHEN length(who) NOT BETWEEN 1 AND 128 THEN 'user_id' END) AS broken_rules
FROM (SELECT click_id, ad_id - 1 AS ad,
             CASE WHEN CAST(click_id AS BIGINT) % 50 = 0 THEN '' WHEN CAST(click_id AS BIGINT) % 50 = 1
                  THEN repeat('x', 129) ELSE user_id END AS who
      FROM ({inputs.attempts_sql()}))
""",
)
def _validate_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = inputs.attempts(spark, sf_dir).withColumns(
        {
            "ad_id": F.col("ad_id") - 1,
            "user_id": F.when(_case(0), "").when(_case(1), F.repeat(F.lit("x"), 129)).otherwise(F.col("user_id")),
        }
    )
    checked = filtering.validate_attempts(attempts)
    return checked.select("click_id", F.array_join("broken_rules", ",").alias("broken_rules"))


def _hot_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with every fifth ad hot, salted."""
    flagged = inputs.clicks(spark, sf_dir).withColumn("hot", F.col("ad_id") % 5 == 0)
    return click_source.assign_salt(flagged)


_SALT_SQL = "CAST('0x' || substr(md5(click_id), 1, 8) AS BIGINT) % 12"
_FLAGGED_SQL = f"""
SELECT * REPLACE (CASE WHEN ad_id % 5 = 0 THEN CAST({_SALT_SQL} AS INTEGER) ELSE 0 END AS salt),
       ad_id % 5 = 0 AS hot
FROM ({inputs.clicks_sql()})
"""
_KEY_SQL = "CASE WHEN hot THEN ad_id || '#' || salt ELSE CAST(ad_id AS VARCHAR) END"


@query("assign_salt", f"SELECT click_id, hot, salt FROM ({_FLAGGED_SQL})")
def _assign_salt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot_flagged(spark, sf_dir).select("click_id", "hot", "salt")


@query(
    "encode_events",
    f"""
SELECT {_KEY_SQL} AS key,
       concat('{{"click_id":"', click_id, '","ad_id":', ad_id, ',"advertiser_id":', advertiser_id,
              ',"salt":', salt, ',"user_id":"', user_id, '","clicked_at":"',
              strftime(date_trunc('millisecond', clicked_at), '%Y-%m-%dT%H:%M:%S.%g'), 'Z","receiver":"',
              receiver, '"}}') AS value
FROM ({_FLAGGED_SQL})
""",
)
def _encode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_source.encode_events(_hot_flagged(spark, sf_dir))


# CRC-32 bit by bit, over the key's bytes.
_CRC_SQL = f"""
SELECT key, records,
       xor(list_reduce(
         list_prepend(4294967295::BIGINT,
           list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))),
         lambda crc, byte: list_reduce(
           list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])),
           lambda c, bit: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT) % 12 AS "partition"
FROM (SELECT {_KEY_SQL} AS key, count(*) AS records FROM ({_FLAGGED_SQL}) GROUP BY 1)
"""
_RATES_SQL = f"""
SELECT CAST("partition" AS INTEGER) AS "partition", CAST(sum(records) AS BIGINT) AS records
FROM ({_CRC_SQL}) GROUP BY 1
"""


# The same with a third of all clicks on one hot ad, salted and not.
_HOT_AD_SQL = f"SELECT * FROM ({inputs.clicks_sql('hot_ad')})"
_CRC_OF = _CRC_SQL.replace(f"({_FLAGGED_SQL})", "({clicks})").replace(_KEY_SQL, "{key}")
_SALTED_KEY_SQL = f"CASE WHEN ad_id = 1 THEN '1#' || ({_SALT_SQL}) ELSE CAST(ad_id AS VARCHAR) END"


def _skew_sql(key: str) -> str:
    return f"""
SELECT count(*) AS partitions, CAST(max(records) AS BIGINT) AS most, CAST(min(records) AS BIGINT) AS least,
       max(records) / greatest(CAST(min(records) AS DOUBLE), 1e-9) AS skew
FROM (SELECT "partition", sum(records) AS records
      FROM ({_CRC_OF.format(key=key, clicks=_HOT_AD_SQL)}) GROUP BY 1)
"""


@query(
    "salting_effect",
    f"""
SELECT true AS salting, * FROM ({_skew_sql(_SALTED_KEY_SQL)})
UNION ALL SELECT false, * FROM ({_skew_sql("CAST(ad_id AS VARCHAR)")})
""",
)
def _salting_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = inputs.clicks(spark, sf_dir, "hot_ad").withColumn("hot", F.col("ad_id") == 1)

    def skew(salting: bool) -> DataFrame:
        records = click_source.encode_events(click_source.assign_salt(clicks, salting), salting)
        rates = measurement.partition_rates(records)
        return measurement.partition_skew(rates).select(F.lit(salting).alias("salting"), "*")

    return skew(True).unionByName(skew(False))


@query("partition_rates", _RATES_SQL)
def _partition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement.partition_rates(_encode_events(spark, sf_dir))


@query(
    "partition_skew",
    f"""
SELECT count(*) AS partitions, max(records) AS most, min(records) AS least,
       max(records) / greatest(CAST(min(records) AS DOUBLE), 1e-9) AS skew
FROM ({_RATES_SQL})
""",
)
def _partition_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement.partition_skew(_partition_rates(spark, sf_dir))


# -- filtering --------------------------------------------------------------------------------

_CLICKS_SQL = inputs.clicks_sql(nulls=True)
_LABEL_SQL = f"""
SELECT click_id, ad_id, advertiser_id, salt, user_id, clicked_at,
       CASE WHEN salt IS NULL THEN 'malformed'
            WHEN epoch_ms(TIMESTAMP '{inputs.AS_OF}') - epoch_ms(clicked_at) > {inputs.LATE_MS} THEN 'late'
            ELSE 'kept' END AS disposition
FROM ({_CLICKS_SQL})
"""
_KEPT_SQL = f"SELECT * FROM ({_LABEL_SQL}) WHERE disposition = 'kept'"


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.clicks(spark, sf_dir, nulls=True)


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.keep_click(_clicks(spark, sf_dir), _as_of(), inputs.LATE_MS)


@query("keep_click", f"SELECT click_id, ad_id, advertiser_id, salt, user_id, clicked_at FROM ({_KEPT_SQL})")
def _keep_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).drop("receiver")


@query("click_disposition", f"SELECT click_id, disposition FROM ({_LABEL_SQL})")
def _click_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = filtering.disposition(_as_of(), inputs.LATE_MS)
    return _with_click_id(_clicks(spark, sf_dir), disposition=label)


@query(
    "drop_counters",
    f"""
SELECT count(*) FILTER (disposition = 'late') AS dropped_late,
       count(*) FILTER (disposition = 'malformed') AS dropped_malformed,
       count(*) FILTER (disposition = 'kept') AS kept
FROM ({_LABEL_SQL})
""",
)
def _drop_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.drop_counters(_clicks(spark, sf_dir), _as_of(), inputs.LATE_MS)


# -- time buckets -----------------------------------------------------------------------------


@query("minute_floor", f"SELECT click_id, date_trunc('minute', clicked_at) AS minute FROM ({_CLICKS_SQL})")
def _minute_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_click_id(_clicks(spark, sf_dir), minute=tb.minute_floor(F.col("clicked_at")))


def _ceil_sql(granularity: str) -> str:
    floor = f"date_trunc('{granularity}', clicked_at)"
    return f"CASE WHEN {floor} = clicked_at THEN clicked_at ELSE {floor} + INTERVAL 1 {granularity} END"


@query(
    "bucket_ceil",
    f"""
SELECT click_id, {_ceil_sql('minute')} AS minute, {_ceil_sql('hour')} AS hour, {_ceil_sql('day')} AS day
FROM ({_CLICKS_SQL})
""",
)
def _bucket_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = {name: tb.bucket_ceil(F.col("clicked_at"), name) for name in tb.GRANULARITIES}
    return _with_click_id(_clicks(spark, sf_dir), **ends)


# -- counting ---------------------------------------------------------------------------------

_COUNTS_OF = """
SELECT ad_id, max(advertiser_id) AS advertiser_id, date_trunc('minute', clicked_at) AS minute,
       count(*) AS click_count, date_trunc('minute', clicked_at) + INTERVAL 1 MINUTE AS updated_at
FROM ({clicks}) GROUP BY ad_id, date_trunc('minute', clicked_at)
"""


def counts_sql(clicks: str) -> str:
    return _COUNTS_OF.format(clicks=clicks)


_KEPT_COUNTS_SQL = counts_sql(_KEPT_SQL)
_ALL_COUNTS_SQL = counts_sql(inputs.clicks_sql())


def _minute_after() -> Column:
    return F.col("minute") + F.expr("INTERVAL 1 MINUTE")


def _all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.recount(inputs.clicks(spark, sf_dir), _minute_after())


# Where the counts of a folder's events are kept, by application, folder and state of its files.
_COUNTS_AT: dict[tuple, str] = {}


def _stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts, written once while the events stay as they are, and read by day, owner, minute."""
    files = inputs.table(spark, sf_dir, "events").select("_metadata.*").groupBy("file_path").agg(
        F.max("file_size").alias("size"), F.max("file_modification_time").alias("changed")
    )
    state = tuple(sorted(map(tuple, files.collect())))
    place = (spark.sparkContext.applicationId, sf_dir, state)
    if place not in _COUNTS_AT:
        path = scratch_path(spark, "click-counts")
        write_counts(_all_counts(spark, sf_dir), path)
        _COUNTS_AT[place] = path
    return read_counts(spark, _COUNTS_AT[place])


@query(
    "salted_partials",
    f"""
SELECT ad_id, advertiser_id, salt, date_trunc('minute', clicked_at) AS minute, count(*) AS partial
FROM ({_KEPT_SQL}) GROUP BY ALL
""",
)
def _salted_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.salted_partials(_kept(spark, sf_dir))


@query("salted_minute_counts", _KEPT_COUNTS_SQL)
def _salted_minute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.salted_minute_counts(_kept(spark, sf_dir), _minute_after())


@query("minute_counts", _KEPT_COUNTS_SQL)
def _minute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.minute_counts(_kept(spark, sf_dir), _minute_after())


@query("recount", _ALL_COUNTS_SQL)
def _recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_counts(spark, sf_dir)


@query(
    "repair_counts",
    counts_sql(f"SELECT * FROM ({_CLICKS_SQL}) WHERE salt IS NOT NULL"),
)
def _repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    recounted = counting.recount(_clicks(spark, sf_dir), _minute_after())
    return counting.repair_counts(_minute_counts(spark, sf_dir), recounted)


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each count as three growing versions, the run restarted before the last."""
    version = F.col("version")
    return (
        _all_counts(spark, sf_dir)
        .withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        .withColumn("click_count", F.ceil(F.col("click_count") * version / 3).cast("long"))
        .withColumn("run_seq", F.when(version == 3, 2).otherwise(1).cast("long"))
        .withColumn("batch_id", F.when(version == 3, 0).otherwise(version).cast("long"))
        .drop("version")
    )


@query("upsert_latest", _ALL_COUNTS_SQL)
def _upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.upsert_latest(_versions(spark, sf_dir))


# -- series -----------------------------------------------------------------------------------


def _sql_range(span: Span) -> str:
    low, high = (moment.strftime("%Y-%m-%d %H:%M:%S") for moment in (span.start, span.end))
    return f"minute >= TIMESTAMP '{low}' AND minute < TIMESTAMP '{high}'"


def _spine_sql(span: Span) -> str:
    low, high = (moment.strftime("%Y-%m-%d %H:%M:%S") for moment in (span.start, span.end))
    return (
        f"SELECT unnest(range(TIMESTAMP '{low}', TIMESTAMP '{high}', INTERVAL 1 {span.granularity})) AS bucket"
    )


def _points_sql(span: Span, where: str) -> str:
    return f"""
SELECT date_trunc('{span.granularity}', minute) AS bucket, CAST(sum(click_count) AS BIGINT) AS clicks,
       max(updated_at) AS last_updated_at
FROM ({_ALL_COUNTS_SQL}) WHERE {_sql_range(span)} AND {where} GROUP BY 1
"""


def _filled_sql(span: Span, where: str) -> str:
    return f"""
SELECT s.bucket, coalesce(p.clicks, 0) AS clicks, p.last_updated_at
FROM ({_spine_sql(span)}) s LEFT JOIN ({_points_sql(span, where)}) p ON s.bucket = p.bucket
"""


@query("ad_series", _filled_sql(ONE_DAY, f"advertiser_id = {OWNER} AND ad_id = {AD}"))
def _ad_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.ad_series(_stored_counts(spark, sf_dir), OWNER, AD, ONE_DAY)


@query("foreign_ad_series", _filled_sql(MONTH, f"advertiser_id = {OWNER} AND ad_id = {AD + 1}"))
def _foreign_ad_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.ad_series(_stored_counts(spark, sf_dir), OWNER, AD + 1, MONTH)


@query("zero_filled_series", _filled_sql(MONTH, f"advertiser_id = {OWNER}"))
def advertiser_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.advertiser_series(_stored_counts(spark, sf_dir), OWNER, MONTH)


@query(
    "advertiser_grouping_sets",
    f"""
SELECT bucket, ad_id, CAST(grouping(bucket, ad_id) AS BIGINT) AS grouping,
       CAST(sum(click_count) AS BIGINT) AS clicks, max(updated_at) AS last_updated_at
FROM (SELECT date_trunc('hour', minute) AS bucket, ad_id, click_count, updated_at FROM ({_ALL_COUNTS_SQL})
      WHERE advertiser_id = {OWNER} AND {_sql_range(MONTH)})
GROUP BY GROUPING SETS ((bucket), (ad_id))
""",
)
def _advertiser_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.advertiser_groups(_stored_counts(spark, sf_dir), OWNER, MONTH)


@query(
    "by_ad_totals",
    f"""
SELECT ad_id, CAST(sum(click_count) AS BIGINT) AS clicks FROM ({_ALL_COUNTS_SQL})
WHERE advertiser_id = {OWNER} AND {_sql_range(MONTH)} GROUP BY 1 HAVING sum(click_count) > 0
ORDER BY clicks DESC, ad_id
""",
)
def _by_ad_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.by_ad_of(_advertiser_grouping_sets(spark, sf_dir))


@query(
    "series_totals",
    f"""
SELECT CAST(coalesce(sum(clicks), 0) AS BIGINT) AS total, max(last_updated_at) AS last_updated_at
FROM ({_filled_sql(MONTH, f"advertiser_id = {OWNER}")})
""",
)
def _series_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series_totals(advertiser_month(spark, sf_dir))


@query(
    "advertiser_rollups",
    f"""
SELECT advertiser_id, date_trunc('hour', minute) AS bucket, CAST(sum(click_count) AS BIGINT) AS clicks,
       max(updated_at) AS last_updated_at
FROM ({_ALL_COUNTS_SQL}) GROUP BY 1, 2
""",
)
def _advertiser_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rollup(_stored_counts(spark, sf_dir), "hour", "advertiser_id")


@query(
    "zero_filled_ads",
    f"""
SELECT a.ad_id, s.bucket, coalesce(p.clicks, 0) AS clicks, p.last_updated_at
FROM (SELECT DISTINCT ad_id FROM ({_ALL_COUNTS_SQL}) WHERE {_sql_range(MONTH_BY_DAY)}) a
CROSS JOIN ({_spine_sql(MONTH_BY_DAY)}) s
LEFT JOIN (SELECT ad_id, date_trunc('day', minute) AS bucket, CAST(sum(click_count) AS BIGINT) AS clicks,
                  max(updated_at) AS last_updated_at
           FROM ({_ALL_COUNTS_SQL}) WHERE {_sql_range(MONTH_BY_DAY)} GROUP BY 1, 2) p
  ON a.ad_id = p.ad_id AND s.bucket = p.bucket
""",
)
def _zero_filled_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = series.in_span(_stored_counts(spark, sf_dir), MONTH_BY_DAY)
    return series.zero_fill_per(series.rollup(ranged, "day", "ad_id"), MONTH_BY_DAY, "ad_id")


_TOTAL_SQL = f"(SELECT CAST(sum(click_count) AS BIGINT) FROM ({_ALL_COUNTS_SQL}) WHERE {_sql_range(MONTH)})"


@query(
    "rollup_consistency",
    f"""
SELECT {_TOTAL_SQL} AS minute_total, {_TOTAL_SQL} AS hour_total, {_TOTAL_SQL} AS day_total, true AS consistent
""",
)
def _rollup_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rollup_consistency(_stored_counts(spark, sf_dir), MONTH)


# -- catalogue --------------------------------------------------------------------------------

_ACTIVE_SQL = f"SELECT * FROM ({inputs.ADS_SQL}) WHERE active"


@query(
    "enrich_clicks",
    f"""
SELECT t.ad_id, t.click_id, t.user_id, t.attempted_at, t.dedup_ok, t.produce, a.advertiser_id, a.redirect_url
FROM ({inputs.attempts_sql()}) t JOIN ({_ACTIVE_SQL}) a ON t.ad_id = a.id
""",
)
def _enrich_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.enrich_clicks(inputs.attempts(spark, sf_dir), inputs.ads(spark, sf_dir))


@query(
    "unknown_ad_clicks",
    f"""
SELECT * FROM ({inputs.attempts_sql()}) WHERE ad_id NOT IN (SELECT id FROM ({_ACTIVE_SQL}))
""",
)
def _unknown_ad_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unknown_ad_clicks(inputs.attempts(spark, sf_dir), inputs.ads(spark, sf_dir))


@query(
    "active_ads_page",
    f"""
SELECT id, advertiser_id, content, img_url, redirect_url, active, created_at, updated_at, next_after_id,
       concat('https://go.example/click/', id) AS click_url
FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn,
             CASE WHEN count(*) OVER () > 25 THEN nth_value(id, 25) OVER (ORDER BY id
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_after_id
      FROM ({_ACTIVE_SQL}) WHERE id > 40)
WHERE rn <= 25
""",
)
def _active_ads_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.active_ads_page(inputs.ads(spark, sf_dir), 40, 25, "https://go.example/click/")


@query("newest_active_ads", f"{_ACTIVE_SQL} ORDER BY id DESC LIMIT 50")
def _newest_active_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.newest_active_ads(inputs.ads(spark, sf_dir), 50)


@query("advertiser_ads", f"SELECT * FROM ({inputs.ADS_SQL}) WHERE advertiser_id = {OWNER}")
def _advertiser_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.advertiser_ads(inputs.ads(spark, sf_dir), OWNER, include_inactive=True)


@query("advertiser_active_ads", f"SELECT * FROM ({_ACTIVE_SQL}) WHERE advertiser_id = {OWNER}")
def _advertiser_active_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.advertiser_ads(inputs.ads(spark, sf_dir), OWNER)


@query("active_ad", f"SELECT * FROM ({_ACTIVE_SQL}) WHERE id = {AD}")
def _active_ad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.active_ad(inputs.ads(spark, sf_dir), AD)


@query("advertiser", f"SELECT * FROM ({inputs.ADVERTISERS_SQL}) WHERE id = {OWNER}")
def _advertiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.advertiser(inputs.advertisers(spark, sf_dir), OWNER)


def _odd_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ads broken in several ways, some owned by nobody."""
    number = F.col("id")
    return inputs.ads(spark, sf_dir).withColumns(
        {
            "advertiser_id": number % 150 + 1,
            "content": F.when(number % 6 == 0, "")
            .when(number % 6 == 1, F.repeat(F.lit("c"), 2001))
            .when(number % 6 == 2, F.repeat(F.lit("c"), 2000))
            .otherwise(F.col("content")),
            "img_url": F.when(number % 5 == 0, "no-scheme.png").otherwise(F.col("img_url")),
            "redirect_url": F.when(number % 7 == 0, "ftp://files.example/x")
            .when(number % 7 == 1, "/relative")
            .when(number % 7 == 2, "https://")
            .otherwise(F.col("redirect_url")),
        }
    )


_ODD_ADS_SQL = f"""
SELECT id, id % 150 + 1 AS advertiser_id,
       CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN repeat('c', 2001) WHEN 2 THEN repeat('c', 2000)
            ELSE content END AS content,
       CASE WHEN id % 5 = 0 THEN 'no-scheme.png' ELSE img_url END AS img_url,
       CASE id % 7 WHEN 0 THEN 'ftp://files.example/x' WHEN 1 THEN '/relative' WHEN 2 THEN 'https://'
            ELSE redirect_url END AS redirect_url, active, created_at, updated_at
FROM ({inputs.ADS_SQL})
"""
_ODD_VERDICT_SQL = f"""
SELECT *, concat_ws(',', CASE WHEN id % 6 IN (0, 1) THEN 'content' END, CASE WHEN id % 5 = 0 THEN 'img_url' END,
                    CASE WHEN id % 7 IN (0, 1, 2) THEN 'redirect_url' END,
                    CASE WHEN advertiser_id NOT IN (SELECT s_suppkey + 1 FROM supplier) THEN 'advertiser_id' END)
            AS broken_rules
FROM ({_ODD_ADS_SQL})
"""


@query("validate_ads", f"SELECT id, broken_rules FROM ({_ODD_VERDICT_SQL})")
def _validate_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = catalog.validate_ads(_odd_ads(spark, sf_dir), inputs.advertisers(spark, sf_dir))
    return checked.select("id", F.array_join("broken_rules", ",").alias("broken_rules"))


_NOW = "2024-02-01 00:00:00"


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp")


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_ads(spark, sf_dir).withColumn("id", F.col("id") + 1_000_000)


@query(
    "create_ads",
    f"""
SELECT * FROM ({inputs.ADS_SQL})
UNION ALL
SELECT id + 1000000, advertiser_id, content, img_url, redirect_url, true, TIMESTAMP '{_NOW}', TIMESTAMP '{_NOW}'
FROM ({_ODD_VERDICT_SQL}) WHERE broken_rules = ''
""",
)
def _create_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.create_ads(
        inputs.ads(spark, sf_dir), _proposals(spark, sf_dir), inputs.advertisers(spark, sf_dir), _now()
    )


@query("rejected_ads", f"SELECT id + 1000000 AS id FROM ({_ODD_VERDICT_SQL}) WHERE broken_rules <> ''")
def _rejected_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rejected_ads(_proposals(spark, sf_dir), inputs.advertisers(spark, sf_dir)).select("id")


def _one_change_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return inputs.table(spark, sf_dir, "customer").select(
        (key + 1).alias("id"),
        (key % 10 + 1 + F.when(key % 7 == 0, 1).otherwise(0)).alias("advertiser_id"),
        F.col("c_name").alias("content"),
        F.lit(None).cast("string").alias("img_url"),
        F.when(key % 11 == 0, "nowhere")
        .otherwise(F.concat(F.lit("https://changed.example/"), key.cast("string")))
        .alias("redirect_url"),
        (key % 3 != 0).alias("active"),
    )


@query(
    "update_ads",
    f"""
SELECT a.id, a.advertiser_id, CASE WHEN c.id IS NULL THEN a.content ELSE c.content END AS content,
       CASE WHEN c.id IS NULL THEN a.img_url END AS img_url,
       coalesce(c.redirect_url, a.redirect_url) AS redirect_url, coalesce(c.active, a.active) AS active,
       a.created_at, CASE WHEN c.id IS NULL THEN a.updated_at ELSE TIMESTAMP '{_NOW}' END AS updated_at
FROM ({inputs.ADS_SQL}) a
LEFT JOIN (SELECT c_custkey + 1 AS id, c_custkey % 10 + 1 AS advertiser_id, c_name AS content,
                  concat('https://changed.example/', c_custkey) AS redirect_url, c_custkey % 3 <> 0 AS active
           FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0) c
  ON a.id = c.id AND a.advertiser_id = c.advertiser_id
""",
)
def _update_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.update_ads(inputs.ads(spark, sf_dir), _one_change_per_customer(spark, sf_dir), _now())


@query(
    "soft_delete_ads",
    f"""
SELECT a.id, a.advertiser_id, a.content, a.img_url, a.redirect_url, a.active AND d.id IS NULL AS active,
       a.created_at,
       CASE WHEN d.id IS NOT NULL AND a.active THEN TIMESTAMP '{_NOW}' ELSE a.updated_at END AS updated_at
FROM ({inputs.ADS_SQL}) a
LEFT JOIN (SELECT DISTINCT o_custkey + 1 AS id, o_custkey % 10 + 1 AS advertiser_id FROM orders) d
  ON a.id = d.id AND a.advertiser_id = d.advertiser_id
""",
)
def _soft_delete_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    deletes = inputs.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") + 1).alias("id"), (F.col("o_custkey") % 10 + 1).alias("advertiser_id")
    )
    return catalog.soft_delete_ads(inputs.ads(spark, sf_dir), deletes, _now())


# Follows each ad's changes one by one.
_APPLY_SQL = f"""
WITH RECURSIVE base AS (
  SELECT *, CAST(-1 AS BIGINT) AS born FROM ({inputs.ADS_SQL})
  UNION ALL
  SELECT id, advertiser_id, content, img_url, redirect_url, true, changed_at, changed_at, seq
  FROM ({inputs.AD_CHANGES_SQL})
  WHERE op = 'create' AND redirect_url LIKE 'https://%' AND advertiser_id IN (SELECT s_suppkey + 1 FROM supplier)
), steps AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.id ORDER BY c.seq) AS rn
  FROM ({inputs.AD_CHANGES_SQL}) c JOIN base b ON c.id = b.id AND c.advertiser_id = b.advertiser_id
  WHERE c.op <> 'create' AND c.seq > b.born
), walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, id, advertiser_id, content, img_url, redirect_url, active, created_at, updated_at
  FROM base
  UNION ALL
  SELECT s.rn, w.id, w.advertiser_id, CASE WHEN s.op = 'update' THEN s.content ELSE w.content END,
         CASE WHEN s.op = 'update' THEN s.img_url ELSE w.img_url END,
         CASE WHEN s.op = 'update' THEN s.redirect_url ELSE w.redirect_url END,
         s.op = 'update' AND s.active, w.created_at,
         CASE WHEN s.op = 'update' OR w.active THEN s.changed_at ELSE w.updated_at END
  FROM walk w JOIN steps s ON w.id = s.id AND s.rn = w.rn + 1
)
SELECT id, arg_max(advertiser_id, rn) AS advertiser_id, arg_max(content, rn) AS content,
       (max(struct_pack(rn := rn, v := img_url))).v AS img_url, arg_max(redirect_url, rn) AS redirect_url,
       arg_max(active, rn) AS active, arg_max(created_at, rn) AS created_at, arg_max(updated_at, rn) AS updated_at
FROM walk GROUP BY id
"""


@query("apply_ad_changes", _APPLY_SQL)
def _apply_ad_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.apply_ad_changes(
        inputs.ads(spark, sf_dir), inputs.ad_changes(spark, sf_dir), inputs.advertisers(spark, sf_dir)
    )


@query(
    "create_advertisers",
    f"""
SELECT * FROM ({inputs.ADVERTISERS_SQL})
UNION ALL
SELECT c_custkey + 1000000, CASE WHEN c_custkey % 9 = 2 THEN repeat('n', 200) ELSE c_name END, TIMESTAMP '{_NOW}'
FROM customer WHERE c_custkey % 9 NOT IN (0, 1)
""",
)
def _create_advertisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    new = inputs.table(spark, sf_dir, "customer").select(
        (key + 1_000_000).alias("id"),
        F.when(key % 9 == 0, "")
        .when(key % 9 == 1, F.repeat(F.lit("n"), 201))
        .when(key % 9 == 2, F.repeat(F.lit("n"), 200))
        .otherwise(F.col("c_name"))
        .alias("name"),
        _now().alias("created_at"),
    )
    return catalog.create_advertisers(inputs.advertisers(spark, sf_dir), new)


# -- dedup and outcomes -----------------------------------------------------------------------


def walk_sql(shape: str, ttl_seconds: int, plain: bool = False) -> str:
    """Follows each (ad, user) attempt by attempt."""
    ok, ack = ("true", "true") if plain else ("a.dedup_ok", "a.produce = 'ack'")
    recorded = "'accepted'" if plain else "CASE WHEN a.produce = 'ack' THEN 'accepted' ELSE a.produce END"
    ttl = ttl_seconds * 1_000_000
    return f"""
WITH RECURSIVE a AS (
  SELECT *, epoch_us(attempted_at) AS t,
         row_number() OVER (PARTITION BY ad_id, user_id ORDER BY attempted_at, click_id) AS rn
  FROM ({inputs.attempts_sql(shape)})
), walk AS (
  SELECT a.ad_id, a.user_id, a.rn, a.click_id, a.attempted_at, {recorded} AS status,
         CASE WHEN {ok} AND {ack} THEN a.t + {ttl} ELSE -1 END AS free_at
  FROM a WHERE rn = 1
  UNION ALL
  SELECT a.ad_id, a.user_id, a.rn, a.click_id, a.attempted_at,
         CASE WHEN {ok} AND a.t < w.free_at THEN 'duplicate' ELSE {recorded} END,
         CASE WHEN {ok} AND {ack} AND a.t >= w.free_at THEN a.t + {ttl} ELSE w.free_at END
  FROM walk w JOIN a ON a.ad_id = w.ad_id AND a.user_id = w.user_id AND a.rn = w.rn + 1
)
SELECT click_id, ad_id, user_id, attempted_at, status FROM walk
"""


def _dedup(spark: SparkSession, sf_dir: str, shape: str, ttl_seconds: int) -> DataFrame:
    attempts = inputs.attempts(spark, sf_dir, shape).select("click_id", "ad_id", "user_id", "attempted_at")
    return dedup.dedup_clicks(attempts, ttl_seconds)


@query(
    "dedup_clicks_copies",
    f"""
SELECT click_id, ad_id, user_id, attempted_at,
       CASE WHEN i > 1 AND status = 'accepted' AND CAST(click_id AS BIGINT) % 97 <> 0 THEN 'duplicate'
            ELSE status END AS status
FROM ({walk_sql('dense', 86_400)}) JOIN (SELECT unnest(range(1, 4)) AS i)
  ON i = 1 OR CAST(click_id AS BIGINT) % 3 = 0
""",
)
def _dedup_clicks_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all attempts delivered three times: one answer counts."""
    times = F.when(F.pmod(F.col("click_id").cast("long"), F.lit(3)) == 0, 3).otherwise(1)
    delivered = inputs.attempts(spark, sf_dir, "dense").withColumn(
        "delivery", F.explode(F.sequence(F.lit(1), times))
    )
    found = dedup.outcomes_of_deliveries(delivered.drop("delivery"), 86_400)
    return found.select("click_id", "ad_id", "user_id", "attempted_at", "status")


@query("dedup_clicks", walk_sql("dense", 600, plain=True))
def _dedup_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup(spark, sf_dir, "dense", 600)


@query("dedup_clicks_daily", walk_sql("dense", 86_400, plain=True))
def _dedup_clicks_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup(spark, sf_dir, "dense", 86_400)


@query("dedup_clicks_hot_key", walk_sql("hot_key", 3_600, plain=True))
def _dedup_clicks_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup(spark, sf_dir, "hot_key", 3_600)


def _classified_sql(shape: str, ttl_seconds: int) -> str:
    return f"""
SELECT w.click_id, w.ad_id, w.user_id, w.attempted_at, ad.advertiser_id,
       CASE WHEN ad.id IS NULL THEN 'not_found' ELSE w.status END AS status
FROM ({walk_sql(shape, ttl_seconds)}) w LEFT JOIN ({_ACTIVE_SQL}) ad ON w.ad_id = ad.id
"""


@query("classify_attempts", _classified_sql('sparse', SPARSE_TTL))
def _classify_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = dedup.classify_attempts(
        inputs.attempts(spark, sf_dir), inputs.ads(spark, sf_dir), 86_400
    )
    return classified.select("click_id", "ad_id", "user_id", "attempted_at", "advertiser_id", "status")


@query(
    "outcome_counts",
    f"""
SELECT status, ad_id % 5 = 0 AS hot, count(*) AS attempts FROM ({_classified_sql('sparse', SPARSE_TTL)}) GROUP BY ALL
""",
)
def _outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = _classify_attempts(spark, sf_dir).withColumn("hot", F.col("ad_id") % 5 == 0)
    return dedup.outcome_counts(classified)


# -- hot ads ----------------------------------------------------------------------------------

_DENSE_SQL = inputs.clicks_sql("dense")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.clicks(spark, sf_dir, "dense")


@query(
    "sliding_10m",
    f"""
SELECT ad_id, bucket, n, CAST(sum(n) OVER (PARTITION BY ad_id ORDER BY bucket
         RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS total
FROM (SELECT ad_id, CAST(floor(epoch(clicked_at) / 60) AS BIGINT) AS bucket, count(*) AS n
      FROM ({_DENSE_SQL}) GROUP BY 1, 2)
""",
)
def _sliding_10m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot.sliding_totals(_dense(spark, sf_dir))


def _intervals_sql(clicks: str, rules: hot.HotRules = HOT_RULES) -> str:
    return f"""
SELECT ad_id, mark_no, make_timestamp(min(t) * 1000000) AS marked_at,
       make_timestamp((max(t) + {rules.ttl_seconds}) * 1000000) AS hot_until,
       mark_no >= {rules.permanent_after} AS permanent
FROM (
  SELECT ad_id, t, CAST(sum(starts) OVER (PARTITION BY ad_id ORDER BY t) AS BIGINT) AS mark_no
  FROM (
    SELECT ad_id, t, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY ad_id ORDER BY t), {rules.ttl_seconds})
                          >= {rules.ttl_seconds} THEN 1 ELSE 0 END AS starts
    FROM (
      SELECT ad_id, t, bucket, sum(n) OVER (PARTITION BY ad_id, bucket ORDER BY t)
             + coalesce(sum(n) OVER (PARTITION BY ad_id ORDER BY bucket
                 RANGE BETWEEN {rules.window_buckets - 1} PRECEDING AND 1 PRECEDING), 0) AS total
      FROM (SELECT ad_id, t, t // {rules.bucket_seconds} AS bucket, count(*) AS n
            FROM (SELECT ad_id, CAST(floor(epoch(clicked_at)) AS BIGINT) AS t FROM ({clicks})) GROUP BY ALL)
    ) WHERE total >= {rules.threshold}
  )
) GROUP BY ad_id, mark_no
"""


_INTERVALS_SQL = _intervals_sql(_DENSE_SQL)


def hot_markings_sql() -> str:
    return _INTERVALS_SQL


def _markings(clicks: DataFrame) -> DataFrame:
    buckets = stored(hot.hot_buckets(clicks, HOT_RULES), "hot-buckets")
    return hot.hot_intervals(clicks, HOT_RULES, buckets=buckets)


@query("hot_markings", _INTERVALS_SQL)
def _hot_markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markings(_dense(spark, sf_dir))


_PERMANENT_SQL = f"""
SELECT ad_id, min(marked_at) AS permanent_since FROM ({_INTERVALS_SQL}) WHERE permanent GROUP BY 1
"""


@query("permanent_hot", _PERMANENT_SQL)
def _permanent_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot.permanent_hot(_hot_markings(spark, sf_dir))


_VIEW_SQL = f"""
SELECT ad_id, bool_or(permanent) AS permanent, max(mark_no) AS marks,
       max(CASE WHEN hot_until >= TIMESTAMP '{HOT_AS_OF}' THEN hot_until END) AS hot_until
FROM ({_intervals_sql(f"SELECT * FROM ({_DENSE_SQL}) WHERE clicked_at <= TIMESTAMP '{HOT_AS_OF}'")})
GROUP BY ad_id HAVING bool_or(permanent) OR max(hot_until) >= TIMESTAMP '{HOT_AS_OF}'
"""


@query("hot_view", _VIEW_SQL)
def _hot_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(HOT_AS_OF).cast("timestamp")
    return hot.hot_view(_markings(hot.up_to(_dense(spark, sf_dir), as_of)), as_of)


@query("hot_ranking", f"SELECT * FROM ({_VIEW_SQL}) ORDER BY permanent DESC, marks DESC, ad_id")
def _hot_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot.hot_ranking(_hot_view(spark, sf_dir))


@query(
    "hot_gauges",
    f"SELECT count(*) AS hot_ads, count(*) FILTER (permanent) AS hot_ads_permanent FROM ({_VIEW_SQL})",
)
def _hot_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot.hot_gauges(_hot_view(spark, sf_dir))


_VISIBLE_AFTER = 2
_TAGGED_SQL = f"""
WITH intervals AS MATERIALIZED ({_INTERVALS_SQL}),
     since AS (SELECT ad_id, min(marked_at) + INTERVAL {_VISIBLE_AFTER} SECOND AS since FROM intervals
               WHERE permanent GROUP BY 1)
SELECT c.click_id, c.ad_id, c.clicked_at,
       EXISTS (SELECT 1 FROM intervals i WHERE i.ad_id = c.ad_id
               AND c.clicked_at >= i.marked_at + INTERVAL {_VISIBLE_AFTER} SECOND AND c.clicked_at <= i.hot_until)
       OR EXISTS (SELECT 1 FROM since s WHERE s.ad_id = c.ad_id AND c.clicked_at >= s.since) AS hot
FROM ({_DENSE_SQL}) c
"""


@query("tag_hot_clicks", _TAGGED_SQL)
def _tag_hot_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = hot.tag_hot_clicks(
        _dense(spark, sf_dir),
        stored(_hot_markings(spark, sf_dir), "markings"),
        slot_seconds=HOT_RULES.ttl_seconds,
        visible_after=_VISIBLE_AFTER,
    )
    return tagged.select("click_id", "ad_id", "clicked_at", "hot")


@query(
    "hot_share",
    f"""
SELECT ad_id, count(*) AS clicks, avg(CASE WHEN hot THEN 1 ELSE 0 END) AS hot_share,
       min(CASE WHEN hot THEN clicked_at END) AS first_hot_at
FROM ({_TAGGED_SQL}) GROUP BY 1
""",
)
def _hot_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot.hot_share(_tag_hot_clicks(spark, sf_dir))


# -- the whole way from attempt to event ------------------------------------------------------

SPARSE_RULES = hot.HotRules(
    bucket_seconds=3600, threshold=4, ttl_seconds=36_000, permanent_after=3, stretch_buckets=48
)
_FOLLOWED_SQL = f"""
SELECT click_id, ad_id, advertiser_id, user_id, attempted_at AS clicked_at, status
FROM ({_classified_sql('sparse', SPARSE_TTL)})
"""
_FOLLOWED_HOT_SQL = f"""
WITH followed AS MATERIALIZED ({_FOLLOWED_SQL}),
     intervals AS MATERIALIZED (
       {_intervals_sql("SELECT * FROM followed WHERE status = 'accepted'", SPARSE_RULES)}),
     since AS (SELECT ad_id, min(marked_at) AS since FROM intervals WHERE permanent GROUP BY 1)
SELECT c.*,
       EXISTS (SELECT 1 FROM intervals i WHERE i.ad_id = c.ad_id AND c.clicked_at >= i.marked_at
               AND c.clicked_at <= i.hot_until)
       OR EXISTS (SELECT 1 FROM since s WHERE s.ad_id = c.ad_id AND c.clicked_at >= s.since) AS hot
FROM followed c
"""


def _accept(spark: SparkSession, sf_dir: str) -> Accepted:
    return accept(inputs.attempts(spark, sf_dir), inputs.ads(spark, sf_dir), SPARSE_RULES, SPARSE_TTL)


@query(
    "attempt_outcomes",
    f"SELECT click_id, ad_id, advertiser_id, user_id, clicked_at, status, hot FROM ({_FOLLOWED_HOT_SQL})",
)
def _attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _accept(spark, sf_dir).outcomes
    return found.select("click_id", "ad_id", "advertiser_id", "user_id", "clicked_at", "status", "hot")


@query(
    "accepted_events",
    f"""
SELECT {_KEY_SQL} AS key,
       concat('{{"click_id":"', click_id, '","ad_id":', ad_id, ',"advertiser_id":', advertiser_id,
              ',"salt":', salt, ',"user_id":"', user_id, '","clicked_at":"',
              strftime(date_trunc('millisecond', clicked_at), '%Y-%m-%dT%H:%M:%S.%g'),
              'Z","receiver":"spark"}}') AS value
FROM (SELECT *, CASE WHEN hot THEN CAST({_SALT_SQL} AS INTEGER) ELSE 0 END AS salt
      FROM ({_FOLLOWED_HOT_SQL}) WHERE status = 'accepted')
""",
)
def _accepted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accept(spark, sf_dir).records()


# -- measurement ------------------------------------------------------------------------------

_EXPECTED_SQL = f"""
SELECT advertiser_id, accepted FROM (
  SELECT (ad_id - 1) % 10 + 1 AS advertiser_id, count(*) AS accepted FROM ({inputs.attempts_sql()})
  WHERE produce = 'ack' GROUP BY 1)
UNION ALL SELECT CAST(999 AS BIGINT), CAST(count(*) % 7 + 1 AS BIGINT) FROM ({inputs.attempts_sql()})
"""
_RECONCILED_SQL = f"""
SELECT e.advertiser_id, e.accepted, coalesce(c.counted, 0) AS counted,
       coalesce(c.counted, 0) - e.accepted AS diff
FROM ({_EXPECTED_SQL}) e
LEFT JOIN (SELECT advertiser_id, CAST(sum(click_count) AS BIGINT) AS counted FROM ({_ALL_COUNTS_SQL})
           GROUP BY 1) c ON e.advertiser_id = c.advertiser_id
"""


def _accepted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted clicks per advertiser as a labelled series, with one advertiser never counted."""
    attempts = inputs.attempts(spark, sf_dir)
    owner = (F.pmod(F.col("ad_id") - 1, F.lit(10)) + 1).cast("string")
    accepted = attempts.where("produce = 'ack'").groupBy(owner.alias("advertiser")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    absent = attempts.agg((F.count(F.lit(1)) % 7 + 1).cast("double").alias("value")).select(
        F.lit("999").alias("advertiser"), "value"
    )
    return accepted.unionByName(absent).select(
        F.lit("clicks_accepted_adv").alias("metric"),
        F.create_map(F.lit("advertiser"), "advertiser", F.lit("testid"), F.lit("run-1")).alias("labels"),
        F.lit(inputs.AS_OF).cast("timestamp").alias("ts"),
        "value",
    )


@query("reconcile", _RECONCILED_SQL)
def _reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = sample_source.select_series(_accepted_series(spark, sf_dir), "clicks_accepted_adv", testid="run-1")
    return measurement.reconcile(measurement.expected_from_series(run), _stored_counts(spark, sf_dir))


# A load run of the last two days: what it sent, in whole hours.
_RUN_DAYS = "2 days"
_RUN_SQL = f"""
SELECT *, (ad_id - 1) % 10 + 1 AS advertiser_id FROM ({inputs.attempts_sql()})
WHERE attempted_at >= (SELECT date_trunc('hour', max(ts) - INTERVAL {_RUN_DAYS}) FROM events)
"""


def _run_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of a load run: accepted clicks per advertiser (and one that none was counted for),
    and answers of unknown outcome. Another run's series are beside them."""
    attempts = inputs.attempts(spark, sf_dir)
    ended = attempts.agg(F.max("attempted_at").alias("ended"))
    since = F.date_trunc("hour", F.col("ended") - F.expr(f"INTERVAL {_RUN_DAYS}"))
    sent = attempts.where(F.col("attempted_at") >= ended.select(since).scalar())
    owner = (F.pmod(F.col("ad_id") - 1, F.lit(10)) + 1).cast("string")
    metric = (
        F.when(F.col("produce") == "ack", measurement.ACCEPTED_METRIC)
        .when(F.col("produce") == "ambiguous", "clicks_503")
        .otherwise("clicks_other")
    )
    per = sent.groupBy(metric.alias("metric"), owner.alias("advertiser")).agg(
        F.count(F.lit(1)).cast("double").alias("value"), F.max("attempted_at").alias("ts")
    )
    accepted = per.where(F.col("metric") == measurement.ACCEPTED_METRIC)
    absent = accepted.agg((F.sum("value") % 7 + 1).alias("value"), F.max("ts").alias("ts")).select(
        F.lit(measurement.ACCEPTED_METRIC).alias("metric"), F.lit("999").alias("advertiser"), "value", "ts"
    )
    own = per.unionByName(absent).withColumn("run", F.lit("run-2"))
    other = per.withColumns({"run": F.lit("run-1"), "value": F.col("value") + 1000})
    return own.unionByName(other).select(
        "metric",
        F.create_map(F.lit("advertiser"), "advertiser", F.lit("testid"), "run").alias("labels"),
        "ts",
        "value",
    )


@query(
    "reconcile_verdict",
    f"""
WITH run AS ({_RUN_SQL}),
expected AS (
  SELECT advertiser_id, count(*) AS accepted FROM run WHERE produce = 'ack' GROUP BY 1
  UNION ALL SELECT CAST(999 AS BIGINT), count(*) % 7 + 1 FROM run WHERE produce = 'ack'),
counted AS (
  SELECT advertiser_id, sum(click_count) AS counted FROM ({_ALL_COUNTS_SQL})
  WHERE minute >= (SELECT date_trunc('hour', max(attempted_at) - INTERVAL {_RUN_DAYS}) FROM run
                   WHERE produce = 'ack')
  GROUP BY 1),
compared AS (
  SELECT coalesce(counted, 0) - accepted AS diff
  FROM expected LEFT JOIN counted USING (advertiser_id))
SELECT *, lost = 0 AND over <= ambiguous AS pass FROM (
  SELECT CAST(coalesce(sum(greatest(-diff, 0)), 0) AS BIGINT) AS lost,
         CAST(coalesce(sum(greatest(diff, 0)), 0) AS BIGINT) AS over,
         count(*) FILTER (diff <> 0) AS mismatched,
         (SELECT count(*) FROM run WHERE produce <> 'ack') AS ambiguous
  FROM compared)
""",
)
def _reconcile_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement.reconcile_run(
        _run_series(spark, sf_dir), _stored_counts(spark, sf_dir), "run-2", _RUN_DAYS
    )


_BUCKET = 3600


def _rank_sql(values: str, percent: float) -> str:
    rank = f"CAST(round_even({percent / 100}::DOUBLE * (len({values}) - 1), 0) AS BIGINT)"
    return f"{values}[least(greatest({rank}, 0), len({values}) - 1) + 1]"


_TIMELINE_SQL = f"""
SELECT b.bucket, b.requests, b.errors, 100.0 * b.errors / b.requests AS error_pct,
       {_rank_sql('b.vs', 50)} AS p50, {_rank_sql('b.vs', 95)} AS p95, b.vs[-1] AS max, s.by_status
FROM (SELECT "timestamp" // {_BUCKET} * {_BUCKET} AS bucket, count(*) AS requests,
             count(*) FILTER (status <> '302') AS errors, list_sort(list(metric_value)) AS vs
      FROM ({inputs.SAMPLES_SQL}) GROUP BY 1) b
JOIN (SELECT bucket, string_agg(status || '=' || n, ',' ORDER BY status) AS by_status
      FROM (SELECT "timestamp" // {_BUCKET} * {_BUCKET} AS bucket, status, count(*) AS n
            FROM ({inputs.SAMPLES_SQL}) GROUP BY 1, 2) GROUP BY 1) s ON b.bucket = s.bucket
"""


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = sample_source.request_samples(inputs.samples(spark, sf_dir))
    return measurement.latency_timeline(clicks, _BUCKET)


@query("latency_timeline", _TIMELINE_SQL)
def _latency_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform(
        F.map_entries("by_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return _timeline(spark, sf_dir).withColumn("by_status", F.array_join(entries, ","))


@query(
    "degraded_window",
    f"""
SELECT min(bucket) AS first_bad, max(bucket) AS last_bad, count(*) AS bad_buckets,
       max(bucket) - min(bucket) + {_BUCKET} AS width_seconds
FROM ({_TIMELINE_SQL}) WHERE errors > 0 OR p95 >= 100
""",
)
def _degraded_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement.degraded_window(_timeline(spark, sf_dir), _BUCKET)


_RUNNER_SQL = f"""
SELECT count(*) AS runners, max({_rank_sql('vs', 95)}) AS max_runner_p95,
       (SELECT {_rank_sql('vs', 95)} FROM (SELECT list_sort(list(metric_value)) AS vs FROM ({inputs.SAMPLES_SQL})))
         AS merged_p95
FROM (SELECT runner, list_sort(list(metric_value)) AS vs FROM ({inputs.SAMPLES_SQL}) GROUP BY 1)
"""


@query("runner_p95", _RUNNER_SQL)
def _runner_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement.runner_p95(inputs.samples(spark, sf_dir))


@query(
    "runner_p95_sketch",
    f"""
SELECT runner, count(*) AS n, true AS within FROM (
  SELECT runner, metric_value FROM ({inputs.SAMPLES_SQL})
  UNION ALL SELECT 'all', metric_value FROM ({inputs.SAMPLES_SQL})) WHERE metric_value IS NOT NULL GROUP BY 1
""",
)
def _runner_p95_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The p95 of every runner and of all, merged from stored hourly sketches; within the stated
    error if the share of samples up to it is, which the samples themselves decide."""
    samples = inputs.samples(spark, sf_dir)
    hourly = stored(sketches.latency_sketches(samples, 3600), "latency-sketches")
    every = sketches.merged(hourly, "runner").unionByName(sketches.merged(hourly, F.lit("all").alias("runner")))
    found = sketches.with_quantiles(every, {"p95": 95})
    both = samples.select("runner", "metric_value").unionByName(
        samples.select(F.lit("all").alias("runner"), "metric_value")
    )
    ranks = both.join(found, "runner").groupBy("runner", "n").agg(
        F.count_if(F.col("metric_value") < F.col("p95")).alias("below"),
        F.count_if(F.col("metric_value") <= F.col("p95")).alias("upto"),
    )
    margin = 4 * sketches.rank_error()
    near = (F.col("below") <= (0.95 + margin) * F.col("n")) & (F.col("upto") >= (0.95 - margin) * F.col("n"))
    return ranks.select("runner", "n", near.alias("within"))


@query(
    "runner_p95_interpolated",
    f"""
SELECT runner, count(*) AS n, quantile_cont(metric_value, 0.95) AS p95 FROM ({inputs.SAMPLES_SQL}) GROUP BY 1
""",
)
def _runner_p95_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.interpolated_percentile(
        inputs.samples(spark, sf_dir), ["runner"], "metric_value", 95, "p95"
    )


def _worst_sql(where: str) -> str:
    return f"""(SELECT max({_rank_sql('vs', 95)}) FROM (SELECT list_sort(list(metric_value)) AS vs
        FROM ({inputs.SAMPLES_SQL}) WHERE {where} GROUP BY runner))"""


_FAILED_SQL = f"""(SELECT count(*) FILTER (status <> '302') / count(*)
    FROM ({inputs.SAMPLES_SQL}) WHERE kind = 'click')"""
_LOAD_GATES_SQL = f"""
SELECT 'click p95 steady ms' AS gate, round({_worst_sql("scenario = 'clicks'")}, 1) AS value,
       CAST(100 AS DOUBLE) AS "limit", round({_worst_sql("scenario = 'clicks'")}, 1) < 100 AS pass
UNION ALL SELECT 'click p95 burst ms', round({_worst_sql("scenario = 'clicks_burst'")}, 1), 100,
       round({_worst_sql("scenario = 'clicks_burst'")}, 1) < 100
UNION ALL SELECT 'click error rate %', round({_FAILED_SQL} * 100, 4), 0.1, round({_FAILED_SQL} * 100, 4) < 0.1
UNION ALL SELECT 'click 302 rate %', round((1 - {_FAILED_SQL}) * 100, 4), 99.9,
       round((1 - {_FAILED_SQL}) * 100, 4) > 99.9
UNION ALL SELECT 'query p95 ms', round({_worst_sql("scenario = 'queries'")}, 1), 500,
       round({_worst_sql("scenario = 'queries'")}, 1) < 500
"""


@query("run_gates", _LOAD_GATES_SQL)
def _run_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement.run_gates(inputs.samples(spark, sf_dir), "clicks")


@query(
    "run_gates_chaos",
    f"""
SELECT 'click p95 ms' AS gate, round({_worst_sql("kind = 'click'")}, 1) AS value, CAST(NULL AS DOUBLE) AS "limit",
       CAST(NULL AS BOOLEAN) AS pass
UNION ALL SELECT 'click error rate %', round({_FAILED_SQL} * 100, 4), 1.0, round({_FAILED_SQL} * 100, 4) < 1.0
UNION ALL SELECT 'click 302 rate %', round((1 - {_FAILED_SQL}) * 100, 4), 99.0,
       round((1 - {_FAILED_SQL}) * 100, 4) > 99.0
""",
)
def _run_gates_chaos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement.run_gates(inputs.samples(spark, sf_dir), "chaos")


@query(
    "run_gates_hot",
    f"""
{_LOAD_GATES_SQL}
UNION ALL SELECT 'hot ad seen at s', round(min(waited), 1), 30, coalesce(round(min(waited), 1) < 30, false)
FROM (SELECT (epoch_us(min(clicked_at) FILTER (hot)) - epoch_us(min(clicked_at))) / 1000000.0::DOUBLE AS waited
      FROM ({_TAGGED_SQL}) GROUP BY CAST(click_id AS BIGINT) % 3)
UNION ALL SELECT 'partition skew max/min',
  round((SELECT max(records) / greatest(CAST(min(records) AS DOUBLE), 1e-9) FROM ({_RATES_SQL})), 2), NULL, NULL
""",
)
def _run_gates_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    skew = _partition_skew(spark, sf_dir).select(
        F.lit("partition_skew").alias("measure"), F.col("skew").alias("value")
    )
    runner = F.pmod(F.col("click_id").cast("long"), F.lit(3)).alias("runner")
    seen = measurement.hot_seen(_tag_hot_clicks(spark, sf_dir).select("*", runner))
    return measurement.run_gates(inputs.samples(spark, sf_dir), "hot", skew.unionByName(seen))


@query(
    "run_gates_scale",
    f"""
SELECT 'click p95 ms' AS gate, round({_worst_sql("kind = 'click'")}, 1) AS value, CAST(NULL AS DOUBLE) AS "limit",
       CAST(NULL AS BOOLEAN) AS pass
UNION ALL SELECT 'click error rate %', round({_FAILED_SQL} * 100, 4), NULL, NULL
""",
)
def _run_gates_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement.run_gates(inputs.samples(spark, sf_dir), "scale")


@query(
    "reconcile_empty",
    """
SELECT CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS mismatched,
       CAST(count(*) AS BIGINT) AS ambiguous, false AS pass
FROM events WHERE event_id % 103 = 0 AND event_id % 101 <> 0
""",
)
def _reconcile_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of another name: nothing was expected, so nothing is shown; the ambiguous are counted."""
    run = sample_source.select_series(_accepted_series(spark, sf_dir), "clicks_accepted_adv", testid="run-2")
    judged = measurement.reconcile(measurement.expected_from_series(run), _stored_counts(spark, sf_dir))
    ambiguous = inputs.attempts(spark, sf_dir).agg(F.count_if(F.col("produce") == "ambiguous")).first()[0]
    return measurement.reconcile_verdict(judged, ambiguous)


@query(
    "partition_skew_idle",
    """
SELECT CAST(12 AS BIGINT) AS partitions, count(*) AS most, CAST(0 AS BIGINT) AS least,
       count(*) / CAST(1e-9 AS DOUBLE) AS skew FROM events
""",
)
def _partition_skew_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records with one key: eleven partitions are idle."""
    records = inputs.attempts(spark, sf_dir).select(F.lit("one").alias("key"))
    return measurement.partition_skew(measurement.partition_rates(records))


@query(
    "freshness_gap",
    f"""
SELECT (SELECT max((epoch_us(n.updated_at) - epoch_us(c.clicked_at)) / 1000000.0)
        FROM ({inputs.clicks_sql()}) c JOIN ({_ALL_COUNTS_SQL}) n
          ON c.ad_id = n.ad_id AND date_trunc('minute', c.clicked_at) = n.minute) AS max_lag_seconds,
       (SELECT max(gap) FROM (SELECT (epoch_us(updated_at) - lag(epoch_us(updated_at)) OVER (ORDER BY updated_at))
          / 1000000.0 AS gap FROM ({_ALL_COUNTS_SQL}))) AS max_pause_seconds
""",
)
def _freshness_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement.freshness_gap(inputs.clicks(spark, sf_dir), _stored_counts(spark, sf_dir))
