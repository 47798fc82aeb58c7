"""The click tables, derived from the given tables: in Spark and as DuckDB text, side by side.

Every derivation keeps all rows of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickloom.session import configure

ADVERTISERS_PER_ADS = 10
AD_ID_OFFSET = 21
AS_OF = "2024-01-31 00:00:00"
LATE_DAYS = 7
LATE_MS = LATE_DAYS * 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _owner(ad_id: Column) -> Column:
    return F.pmod(ad_id - 1, F.lit(ADVERTISERS_PER_ADS)) + 1


def _typed(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "ts": F.col("ts").cast("timestamp"),
            "k": F.get_json_object("props", "$.k").cast("long"),
        }
    )


def attempts(spark: SparkSession, sf_dir: str, shape: str = "sparse") -> DataFrame:
    return attempts_of(table(spark, sf_dir, "events"), shape)


def attempts_of(events: DataFrame, shape: str = "sparse", *more: str) -> DataFrame:
    """Events (a table or a stream) as click attempts, with ``more`` of their columns.

    ``sparse``: 100 ads, 20 of them unknown. ``dense``: 5 ads. ``hot_ad``: as sparse, but a third
    of all attempts are on one ad. ``hot_key``: as dense, but a third are by one user on one ad.
    """
    event_id = F.col("event_id")
    one_third = F.pmod(event_id, F.lit(3)) == 0
    ad_id = F.pmod(F.col("k"), F.lit(5)) + 1 if shape in ("dense", "hot_key") else F.col("k") + 1
    user_id = F.concat(F.lit("u-"), F.col("user_id").cast("string"))
    if shape in ("hot_ad", "hot_key"):
        ad_id = F.when(one_third, F.lit(1).cast("long")).otherwise(ad_id)
    if shape == "hot_key":
        user_id = F.when(one_third, F.lit("u-bot")).otherwise(user_id)
    produce = (
        F.when(F.pmod(event_id, F.lit(101)) == 0, "rejected")
        .when(F.pmod(event_id, F.lit(103)) == 0, "ambiguous")
        .when(F.pmod(event_id, F.lit(107)) == 0, "shed")
        .otherwise("ack")
    )
    return _typed(events).select(
        event_id.cast("string").alias("click_id"),
        ad_id.cast("long").alias("ad_id"),
        user_id.alias("user_id"),
        F.col("ts").alias("attempted_at"),
        (F.pmod(event_id, F.lit(97)) != 0).alias("dedup_ok"),
        produce.alias("produce"),
        *more,
    )


def clicks(spark: SparkSession, sf_dir: str, shape: str = "sparse", nulls: bool = False) -> DataFrame:
    return clicks_of(table(spark, sf_dir, "events"), shape, nulls)


def clicks_of(events: DataFrame, shape: str = "sparse", nulls: bool = False, *more: str) -> DataFrame:
    """Attempts as click events; with ``nulls`` some lack a salt and so are malformed."""
    event_id = F.col("click_id").cast("long")
    salt = F.pmod(event_id, F.lit(12)).cast("int")
    if nulls:
        salt = F.when(F.pmod(event_id, F.lit(50)) != 0, salt)
    return attempts_of(events, shape, *more).select(
        "click_id",
        "ad_id",
        _owner(F.col("ad_id")).alias("advertiser_id"),
        salt.alias("salt"),
        "user_id",
        F.col("attempted_at").alias("clicked_at"),
        F.lit("receiver-0").alias("receiver"),
        *more,
    )


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an ad, numbered from 21."""
    key = F.col("p_partkey")
    ad_id = key + AD_ID_OFFSET
    born = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "part").select(
        ad_id.alias("id"),
        _owner(ad_id).alias("advertiser_id"),
        F.col("p_name").alias("content"),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("https://img.example/"), key.cast("string"))).alias(
            "img_url"
        ),
        F.concat(F.lit("https://landing.example/"), ad_id.cast("string")).alias("redirect_url"),
        (F.col("p_size") % 10 != 0).alias("active"),
        born.alias("created_at"),
        born.alias("updated_at"),
    )


def advertisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1).alias("id"),
        F.col("s_name").alias("name"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )


def ad_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer proposes an ad, then every order changes one."""
    key = F.col("c_custkey")
    created = table(spark, sf_dir, "customer").select(
        key.alias("seq"),
        F.lit("create").alias("op"),
        (key + 1_000_000_000).alias("id"),
        (key % 150 + 1).alias("advertiser_id"),
        F.col("c_name").alias("content"),
        F.lit(None).cast("string").alias("img_url"),
        F.when(key % 11 != 0, F.concat(F.lit("https://new.example/"), key.cast("string")))
        .otherwise("not a url")
        .alias("redirect_url"),
        F.lit(True).alias("active"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("changed_at"),
    )
    order = F.col("o_orderkey")
    on_new = order % 5 == 0
    ad_id = F.when(on_new, F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey") + 1)
    owner = F.when(on_new, F.col("o_custkey") % 150 + 1).otherwise(F.col("o_custkey") % 10 + 1)
    changed = table(spark, sf_dir, "orders").select(
        (order + 1_000_000_000).alias("seq"),
        F.when(order % 4 < 2, "update").otherwise("delete").alias("op"),
        ad_id.alias("id"),
        F.when(order % 7 == 0, owner + 1).otherwise(owner).alias("advertiser_id"),
        F.concat(F.lit("v"), order.cast("string")).alias("content"),
        F.lit(None).cast("string").alias("img_url"),
        F.concat(F.lit("https://changed.example/"), order.cast("string")).alias("redirect_url"),
        (order % 3 != 0).alias("active"),
        F.col("o_orderdate").cast("timestamp").alias("changed_at"),
    )
    return created.unionByName(changed)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request samples of three runners."""
    return _typed(table(spark, sf_dir, "events")).select(
        F.lit("http_req_duration").alias("metric_name"),
        F.lit("GET /click/{ad_id}").alias("name"),
        F.when(F.col("event_type") == "error", "503").otherwise("302").alias("status"),
        F.unix_seconds("ts").alias("timestamp"),
        F.col("value").alias("metric_value"),
        F.pmod(F.col("event_id"), F.lit(3)).cast("string").alias("runner"),
        F.when(F.col("event_type") == "view", "query").otherwise("click").alias("kind"),
        F.when(F.col("event_type") == "view", "queries")
        .when(F.col("event_type") == "purchase", "clicks_burst")
        .otherwise("clicks")
        .alias("scenario"),
        F.lit("run-1").alias("testid"),
    )


# The same derivations for DuckDB. `events`, `part`, ... are the given tables.

_ATTEMPT_SQL = """
SELECT CAST(event_id AS VARCHAR) AS click_id,
       {ad} AS ad_id,
       {user} AS user_id,
       ts AS attempted_at,
       event_id % 97 <> 0 AS dedup_ok,
       CASE WHEN event_id % 101 = 0 THEN 'rejected' WHEN event_id % 103 = 0 THEN 'ambiguous'
            WHEN event_id % 107 = 0 THEN 'shed' ELSE 'ack' END AS produce
FROM events
"""
_K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)"
_USER = "concat('u-', CAST(user_id AS VARCHAR))"


def attempts_sql(shape: str = "sparse") -> str:
    ad = f"{_K} % 5 + 1" if shape in ("dense", "hot_key") else f"{_K} + 1"
    user = _USER
    if shape in ("hot_ad", "hot_key"):
        ad = f"CASE WHEN event_id % 3 = 0 THEN 1 ELSE {ad} END"
    if shape == "hot_key":
        user = f"CASE WHEN event_id % 3 = 0 THEN 'u-bot' ELSE {user} END"
    return _ATTEMPT_SQL.format(ad=f"CAST({ad} AS BIGINT)", user=user)


def clicks_sql(shape: str = "sparse", nulls: bool = False) -> str:
    salt = "CAST(click_id AS BIGINT) % 12"
    if nulls:
        salt = f"CASE WHEN CAST(click_id AS BIGINT) % 50 <> 0 THEN {salt} END"
    return f"""
SELECT click_id, ad_id, (ad_id - 1) % 10 + 1 AS advertiser_id, CAST({salt} AS INTEGER) AS salt,
       user_id, attempted_at AS clicked_at, 'receiver-0' AS receiver
FROM ({attempts_sql(shape)})
"""


ADS_SQL = """
SELECT p_partkey + 21 AS id, (p_partkey + 20) % 10 + 1 AS advertiser_id, p_name AS content,
       CASE WHEN p_size % 3 <> 0 THEN concat('https://img.example/', p_partkey) END AS img_url,
       concat('https://landing.example/', p_partkey + 21) AS redirect_url,
       p_size % 10 <> 0 AS active,
       TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
FROM part
"""

ADVERTISERS_SQL = """
SELECT s_suppkey + 1 AS id, s_name AS name, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM supplier
"""

AD_CHANGES_SQL = """
SELECT c_custkey AS seq, 'create' AS op, c_custkey + 1000000000 AS id, c_custkey % 150 + 1 AS advertiser_id,
       c_name AS content, CAST(NULL AS VARCHAR) AS img_url,
       CASE WHEN c_custkey % 11 <> 0 THEN concat('https://new.example/', c_custkey) ELSE 'not a url' END
         AS redirect_url,
       true AS active, TIMESTAMP '2024-02-01 00:00:00' AS changed_at
FROM customer
UNION ALL
SELECT o_orderkey + 1000000000, CASE WHEN o_orderkey % 4 < 2 THEN 'update' ELSE 'delete' END,
       CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1000000000 ELSE o_custkey + 1 END,
       CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 150 + 1 ELSE o_custkey % 10 + 1 END
         + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END,
       concat('v', o_orderkey), CAST(NULL AS VARCHAR), concat('https://changed.example/', o_orderkey),
       o_orderkey % 3 <> 0, CAST(o_orderdate AS TIMESTAMP)
FROM orders
"""

SAMPLES_SQL = """
SELECT 'http_req_duration' AS metric_name, 'GET /click/{ad_id}' AS name,
       CASE WHEN event_type = 'error' THEN '503' ELSE '302' END AS status,
       CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp", value AS metric_value,
       CAST(event_id % 3 AS VARCHAR) AS runner,
       CASE WHEN event_type = 'view' THEN 'query' ELSE 'click' END AS kind,
       CASE WHEN event_type = 'view' THEN 'queries' WHEN event_type = 'purchase' THEN 'clicks_burst'
            ELSE 'clicks' END AS scenario,
       'run-1' AS testid
FROM events
"""
