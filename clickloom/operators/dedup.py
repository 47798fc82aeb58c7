"""Duplicate clicks: a claim per (ad, user) that blocks repeats for a fixed time.

Semantics, per (ad, user) in time order (a hash of the click id decides within one instant):

* a free key is claimed; the claim lasts ``ttl`` from the claiming click and is not
  extended by duplicates; at exactly ``ttl`` later the key is free again;
* an attempt that is then shed, rejected or ambiguous gives its claim back at once;
* while the dedup state is unreachable an attempt counts as new and claims nothing.

So only acknowledged attempts with a reachable state change anything, and the accepted ones
among them form a chain: each is the first at or after the end of the one before. Every
other attempt only reads that chain.

The chain of one key is sequential, but a key may hold a large share of all clicks, so it is
not followed in one task. Time is cut into chunks of a few ``ttl``:

1. Acknowledged attempts collapse to distinct instants, combined before they shuffle, and are
   gathered per (ad, user, chunk), together with the last instants before the chunk that could
   still block it. A chunk holds whole numbers only.
2. A chunk whose first instant nothing can block is independent. For the few *linked* chunks a
   compact step function says when the key is free afterwards for each click the chain may
   enter at.
3. An independent chunk tells the next one when the key becomes free in it. Only where linked
   chunks follow one another are their step functions, not their clicks, followed in order, one
   after the other. Then every chunk is folded on its own.
4. An attempt meets the few claims of its own key and chunk.

Click ids are taken to be unique, as the accepting service makes them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from clickloom.functions.timebuckets import floor_div
from clickloom.operators.filtering import split_valid, validate_attempts
from clickloom.operators.skew import splittable_lookup

# Executors need not have this package: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value.
DEDUP_TTL_SECONDS = 600
CHUNK_TTLS = 8
KEY = ("ad_id", "user_id")

_FUNCTION_TYPE = "struct<entries: array<bigint>, exits: array<bigint>>"
_CLICK_TYPE = "struct<t: bigint, tie: bigint>"
_NEVER = -(2**62)


def _claiming() -> Column:
    return F.col("dedup_ok") & (F.col("produce") == "ack")


def _tie() -> Column:
    """Orders clicks of one instant. A number, unlike the id, can be combined by hash and moved cheaply."""
    return F.xxhash64("click_id")


def _chunks(attempts: DataFrame, ttl: int, length: int) -> DataFrame:
    """Per (ad, user, chunk): its distinct instants in order, and whether a claim before it may
    block the first of them (it is linked).

    An instant near the end of a chunk is also shown to the next chunk, which therefore
    knows without looking at its neighbour. Everything else is derived from the one gathered
    array, so that all uses share its shuffle.
    """
    instants = (
        attempts.where(_claiming() & F.col("ad_id").isNotNull() & F.col("user_id").isNotNull())
        .select(*KEY, F.unix_micros("attempted_at").alias("t"), _tie().alias("tie"))
        .groupBy(*KEY, "t")
        .agg(F.min("tie").alias("tie"))
    )
    chunk = floor_div(F.col("t"), length)
    reaches_on = F.col("t") + F.lit(ttl) > (chunk + 1) * F.lit(length)
    here = F.struct(chunk.alias("chunk"), F.lit(1).alias("own"))
    next_one = F.struct((chunk + 1).alias("chunk"), F.lit(0).alias("own"))
    places = F.when(reaches_on, F.array(here, next_one)).otherwise(F.array(here))
    # The null test changes nothing; stated here, no use of the chunks adds its own below the
    # shuffle and they can all share it.
    seen = (
        instants.select(*KEY, F.struct("t", "tie").alias("click"), F.explode(places).alias("place"))
        .select(*KEY, "click", "place.chunk", "place.own")
        .where(F.col("chunk").isNotNull())
        .groupBy(*KEY, "chunk")
        .agg(F.sort_array(F.collect_list("click")).alias("seen"), F.sum("own").cast("int").alias("own"))
    )
    before = F.size("seen") - F.col("own")
    blocks = F.try_element_at("seen", before)["t"] + F.lit(ttl) > F.try_element_at("seen", before + 1)["t"]
    return seen.select(
        *KEY,
        "chunk",
        F.slice("seen", before + 1, F.col("own")).alias("instants"),
        F.when((before > 0) & (F.col("own") > 0), blocks).otherwise(F.lit(False)).alias("linked"),
    )


def _fold(instants: str, entry: Column, ttl: int) -> Column:
    """The chain through one chunk when the key is free from ``entry`` on."""
    start = F.struct(entry.alias("free_at"), F.array().cast(f"array<{_CLICK_TYPE}>").alias("claims"))

    def step(state: Column, click: Column) -> Column:
        claimed = F.struct(
            (click["t"] + F.lit(ttl)).alias("free_at"),
            F.concat(state["claims"], F.array(click)).alias("claims"),
        )
        return F.when(click["t"] >= state["free_at"], claimed).otherwise(state)

    return F.aggregate(instants, start, step, lambda state: state["claims"])


def _end_of(instants: str, ttl: int) -> Column:
    """When the key is free after an independent chunk."""
    return F.aggregate(
        instants,
        F.lit(_NEVER).cast("long"),
        lambda free_at, click: F.when(click["t"] >= free_at, click["t"] + F.lit(ttl)).otherwise(free_at),
    )


def chunk_function(times: np.ndarray, start: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """For each click the chain may enter a chunk at, when the key is free after the chunk.

    A claim from before ``start`` blocks less than one ``ttl`` of it, so the chain enters at a
    click of that first stretch or at the first click after it. Runs of entries with one
    outcome are merged into their last entry.
    """
    following = np.searchsorted(times, times + ttl, side="left")
    size = len(times)
    last = np.arange(size)
    hop = following.copy()
    while True:
        inside = hop < size
        if not inside.any():
            break
        last = np.where(inside, hop, last)
        hop = np.where(inside, following[np.minimum(hop, size - 1)], hop)
    reachable = min(int(np.searchsorted(times, start + ttl, side="left")) + 1, size)
    exits = times[last[:reachable]] + ttl
    kept = np.append(exits[1:] != exits[:-1], True)
    return times[:reachable][kept], exits[kept]


def _function_udf(ttl: int, length: int):
    @pandas_udf(_FUNCTION_TYPE)
    def outcome(times: pd.Series, chunk: pd.Series) -> pd.DataFrame:
        functions = [
            chunk_function(np.asarray(t, dtype=np.int64), int(c) * length, ttl)
            for t, c in zip(times, chunk)
        ]
        return pd.DataFrame(
            {
                "entries": [entries for entries, _ in functions],
                "exits": [exits for _, exits in functions],
            }
        )

    return outcome


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Go through linked chunks in order, handing each one's outcome to the next of its key.

    One chunk is held at a time, however many a key has.
    """
    free_at = None
    for batch in batches:
        told = []
        for seed, entries, exits in zip(batch["seed"], batch["entries"], batch["exits"]):
            if not pd.isna(seed):
                free_at = int(seed)
            place = np.searchsorted(entries, free_at)
            if place < len(exits):
                free_at = int(exits[place])
            told.append(free_at)
        yield pd.DataFrame(
            {
                "ad_id": batch["ad_id"],
                "user_id": batch["user_id"],
                "chunk": batch["chunk"] + 1,
                "entry": np.array(told, dtype=np.int64),
            }
        )


def _entries(chunks: DataFrame, ttl: int, length: int) -> DataFrame:
    """When the key becomes free in each chunk a claim may reach into: ``(ad, user, chunk, entry)``.

    Told by the chunk before. An independent chunk knows its outcome. A linked one that reaches on
    does not: the first of a row of them starts from what an independent chunk told it (its
    ``seed``), the others from the one before.
    """
    last = F.try_element_at("instants", F.lit(-1))["t"]
    reaching = chunks.where(last + F.lit(ttl) > (F.col("chunk") + 1) * F.lit(length))
    next_chunk = F.coalesce(F.col("chunk") + 1, F.lit(0).cast("long"))
    told = reaching.where(~F.col("linked")).select(
        *KEY, next_chunk.alias("chunk"), _end_of("instants", ttl).alias("entry")
    )
    times = F.transform("instants", lambda click: click["t"])
    linked = (
        reaching.where("linked")
        .select(*KEY, "chunk", _function_udf(ttl, length)(times, F.col("chunk")).alias("outcome"))
        .join(told.withColumnRenamed("entry", "seed"), [*KEY, "chunk"], "left")
        .select(*KEY, "chunk", "seed", "outcome.entries", "outcome.exits")
    )
    followed = (
        linked.repartition(*KEY)
        .sortWithinPartitions(*KEY, "chunk")
        .mapInPandas(_follow, told.schema)
    )
    return told.unionByName(followed)


def _claimed_chunks(attempts: DataFrame, ttl: int, length: int) -> DataFrame:
    """Per (ad, user, chunk): when the key is free in it, and the claims made in it."""
    chunks = _chunks(attempts, ttl, length)
    entry = F.coalesce("entry", F.lit(_NEVER).cast("long"))
    return (
        chunks.select(*KEY, "chunk", "instants")
        .join(_entries(chunks, ttl, length), [*KEY, "chunk"], "left")
        .select(*KEY, "chunk", entry.alias("entry"), _fold("instants", entry, ttl).alias("claims"))
    )


def _lengths(ttl_seconds: int, chunk_ttls: int) -> tuple[int, int]:
    if ttl_seconds < 1 or chunk_ttls < 2:
        raise ValueError("ttl_seconds must be at least 1 and chunk_ttls at least 2")
    ttl = int(ttl_seconds) * 1_000_000
    return ttl, ttl * chunk_ttls


def accepted_claims(
    attempts: DataFrame, ttl_seconds: int = DEDUP_TTL_SECONDS, chunk_ttls: int = CHUNK_TTLS
) -> DataFrame:
    """The accepted, claim-holding attempts: ``(ad_id, user_id, t, tie)``, ``t`` in µs."""
    chunks = _claimed_chunks(attempts, *_lengths(ttl_seconds, chunk_ttls))
    return chunks.select(*KEY, F.explode("claims").alias("claim")).select(*KEY, "claim.t", "claim.tie")


def dedup_outcomes(
    attempts: DataFrame, ttl_seconds: int = DEDUP_TTL_SECONDS, chunk_ttls: int = CHUNK_TTLS
) -> DataFrame:
    """Every attempt with its ``status``: accepted, duplicate, or why it was not recorded."""
    ttl, length = _lengths(ttl_seconds, chunk_ttls)
    t = F.unix_micros("attempted_at")
    placed = attempts.withColumn("chunk", floor_div(t, length))
    joined = splittable_lookup(placed, _claimed_chunks(attempts, ttl, length), [*KEY, "chunk"], "chunk")
    here = F.struct(t.alias("t"), _tie().alias("tie"))
    recorded = F.when(F.col("produce") == "ack", "accepted").otherwise(F.col("produce"))
    is_claim = _claiming() & F.coalesce(F.array_contains("claims", here), F.lit(False))
    blocked = F.coalesce(t < F.col("entry"), F.lit(False)) | F.coalesce(
        F.exists("claims", lambda claim: (claim < here) & (t < claim["t"] + F.lit(ttl))), F.lit(False)
    )
    status = (
        F.when(~F.col("dedup_ok"), recorded)
        .when(is_claim, "accepted")
        .when(blocked, "duplicate")
        .otherwise(recorded)
    )
    return joined.withColumn("status", status).select(*attempts.columns, "status")


def outcomes_of_deliveries(
    attempts: DataFrame, ttl_seconds: int = DEDUP_TTL_SECONDS, chunk_ttls: int = CHUNK_TTLS
) -> DataFrame:
    """As :func:`dedup_outcomes` for attempts that may be delivered more than once.

    Of equal rows the first is answered like any attempt. The others meet its claim: an accepted one
    has been counted, so they are duplicates; one that was not recorded gave its claim back, and while
    the state is unreachable nobody knows of the first. Equal rows are combined before they
    shuffle, however many there are.
    """
    counted = attempts.groupBy(*attempts.columns).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    outcomes = dedup_outcomes(counted, ttl_seconds, chunk_ttls)
    met = F.col("dedup_ok") & (F.col("status") == "accepted")
    again = F.when(met, "duplicate").otherwise(F.col("status"))
    answers = F.concat(F.array("status"), F.array_repeat(again, F.col("_copies") - 1))
    return outcomes.withColumn("status", F.explode(answers)).select(*attempts.columns, "status")


def dedup_clicks(
    clicks: DataFrame, ttl_seconds: int = DEDUP_TTL_SECONDS, chunk_ttls: int = CHUNK_TTLS
) -> DataFrame:
    """Plain dedup of recorded clicks: ``status`` is accepted or duplicate."""
    plain = clicks.withColumns({"dedup_ok": F.lit(True), "produce": F.lit("ack")})
    return dedup_outcomes(plain, ttl_seconds, chunk_ttls).select(*clicks.columns, "status")


def classify_attempts(
    attempts: DataFrame,
    ads: DataFrame,
    ttl_seconds: int = DEDUP_TTL_SECONDS,
    chunk_ttls: int = CHUNK_TTLS,
) -> DataFrame:
    """The outcome of every valid attempt, with the ad's owner and target where it is known.

    Claims depend on the key alone, so the catalogue is joined last: nothing downstream needs
    the join's partitioning and a hot ad's rows can be split between tasks.
    """
    valid, _ = split_valid(validate_attempts(attempts))
    active = ads.where("active").select(F.col("id").alias("ad_id"), "advertiser_id", "redirect_url")
    outcomes = dedup_outcomes(valid, ttl_seconds, chunk_ttls)
    return outcomes.join(active, "ad_id", "left").withColumn(
        "status", F.when(F.col("advertiser_id").isNull(), "not_found").otherwise(F.col("status"))
    )


def outcome_counts(classified: DataFrame) -> DataFrame:
    """Attempts per ``(status, hot)``."""
    return classified.groupBy("status", "hot").agg(F.count(F.lit(1)).alias("attempts"))
