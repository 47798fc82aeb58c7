"""Spreading a hot key over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 16
LANES = 8


def salted_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``facts`` to a ``lookup`` with one row per key where run-time skew splitting cannot help.

    It splits a join of two plain shuffles only: not one whose lookup comes out of an aggregate,
    nor one whose result is then grouped by the same keys, which would keep the join's
    partitioning and with it a hot key in one task. Salted, the rows of a key meet the lookup
    in ``salts`` places, and a later aggregate combines before it shuffles. The lookup is copied
    ``salts`` times, so it must be the smaller side.
    """
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def splittable_lookup(
    facts: DataFrame, lookup: DataFrame, keys: list[str], number: str
) -> DataFrame:
    """Left join to a ``lookup`` that comes out of an aggregate on ``keys``, still open to skew splitting.

    ``number`` is one of the keys. A lane derived from it adds nothing to the match, but being no
    key of the aggregate it makes the join shuffle both sides itself, the shape in which a
    partition full of facts is divided at run time.
    """
    # Never null, so that Catalyst adds no null test below an exchange others could share.
    lane = F.coalesce(F.pmod(F.col(number), F.lit(LANES)), F.lit(0))
    left, right = (side.withColumn("_lane", lane) for side in (facts, lookup))
    return left.join(right, [*keys, "_lane"], "left").drop("_lane")
