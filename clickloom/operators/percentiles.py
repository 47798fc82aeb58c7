"""Exact order statistics per group that no single task has to sort.

``percentile`` and ``collect_list`` gather a whole group in one task; a group may hold a third of
all rows. Here equal values collapse before the shuffle, rows are spread over (group, value
bin), running counts over the few bins tell which bin holds each wanted rank. That bin is divided
again, between its least and greatest value, and so on: of the values of one task's last bin no
more are left than lie in a range 4096 times narrower for each round, whatever their distribution.
Two rounds leave at most some four million distinct doubles to be ordered, and where values spread
at all evenly, a few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS_PER_OCTAVE = 32
SUB_BINS = 4096


def value_bin(value: Column) -> Column:
    """A whole number that never decreases with ``value``, about 2 % of it wide."""
    size = F.abs(value).cast("double")
    octaves = F.log2(F.when((size > 0) & (size < float("inf")), size)) * BINS_PER_OCTAVE
    # Finite values stay below 140,000; infinity and, above all, not-a-number have bins of their own.
    magnitude = F.coalesce(
        F.floor(octaves).cast("long") + F.lit(100_000),
        F.when(F.isnan(size), 300_000).when(size > 0, 200_000).cast("long"),
    )
    return F.coalesce(F.when(value < 0, -magnitude).otherwise(magnitude), F.lit(0).cast("long"))


def _inside(counted: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each target's range."""
    here = F.col("value").between(F.col("low"), F.col("high"))
    return counted.join(targets, [*keys, "bin"]).where(here)


def _narrowed(counted: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Targets (with ``low``, ``high`` and the ``offset`` of the wanted rank from there) narrowed to
    the one of ``SUB_BINS`` parts of their range that holds the rank."""
    value, low, high = (F.col(c).cast("double") for c in ("value", "low", "high"))
    # Halved, so that a range as wide as the numbers go does not overflow.
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    part = F.when(low < high, F.least(F.floor(share * SUB_BINS), F.lit(SUB_BINS - 1))).otherwise(0)
    fixed = [*keys, "bin", "name", "n", "top"]
    parts = (
        _inside(counted, targets, keys)
        .groupBy(*fixed, "offset", part.cast("int").alias("part"))
        .agg(F.sum("times").alias("times"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    running = (
        Window.partitionBy(*fixed).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        parts.withColumn("reached", F.sum("times").over(running))
        .where(
            (F.col("offset") < F.col("reached"))
            & (F.col("offset") >= F.col("reached") - F.col("times"))
        )
        .select(
            *fixed, "low", "high", (F.col("offset") - F.col("reached") + F.col("times")).alias("offset")
        )
    )


def values_at_ranks(
    rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], rounds: int = 2
) -> DataFrame:
    """One row per group with ``n``, the values at the given zero-based ranks, and ``max``.

    Each rank is a column expression of the group's row count ``n``. Null values are ignored.
    """
    held = rows.where(F.col(value).isNotNull())
    counted = held.groupBy(
        *keys, value_bin(F.col(value)).alias("bin"), F.col(value).alias("value")
    ).agg(F.count(F.lit(1)).alias("times"))
    per_group = Window.partitionBy(*keys)
    running = per_group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = (
        counted.groupBy(*keys, "bin")
        .agg(
            F.sum("times").alias("in_bin"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        .withColumn("upto", F.sum("in_bin").over(running))
        .withColumn("n", F.sum("in_bin").over(per_group))
        .withColumn("top", F.max("high").over(per_group))
    )
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]
    )
    before = F.col("upto") - F.col("in_bin")
    targets = (
        bins.withColumn("target", F.explode(wanted))
        .where((F.col("target.rank") >= before) & (F.col("target.rank") < F.col("upto")))
        .select(
            *keys,
            "bin",
            "n",
            "top",
            "low",
            "high",
            "target.name",
            (F.col("target.rank") - before).alias("offset"),
        )
    )
    for _ in range(rounds):
        targets = _narrowed(counted, targets, keys)
    in_order = (
        Window.partitionBy(*keys, "bin", "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    )
    found = (
        _inside(counted, targets, keys)
        .withColumn("reached", F.sum("times").over(in_order))
        .where(
            (F.col("offset") < F.col("reached"))
            & (F.col("offset") >= F.col("reached") - F.col("times"))
        )
    )
    return found.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks],
        F.max("top").alias("max"),
    )


def nearest_rank(percent: float) -> Column:
    """Zero-based rank ``percent / 100 * (n - 1)``, halves to the even neighbour."""
    rank = F.bround(F.lit(percent / 100) * (F.col("n") - 1)).cast("long")
    return F.least(F.greatest(rank, F.lit(0)), F.col("n") - 1)


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per group."""
    return values_at_ranks(rows, keys, value, {name: nearest_rank(p) for name, p in wanted.items()})


def interpolated_percentile(rows: DataFrame, keys: list[str], value: str, percent: float, name: str) -> DataFrame:
    """The exact percentile with linear interpolation between neighbours."""
    place = F.lit(percent / 100) * (F.col("n") - 1)
    pair = values_at_ranks(rows, keys, value, {"low": F.floor(place), "high": F.ceil(place)})
    share = place - F.floor(place)
    return pair.select(
        *keys, "n", (F.col("low") + (F.col("high") - F.col("low")) * share).alias(name)
    )
