"""Near copies by SimHash fingerprints, linked through vantage-point trees.

A fingerprint is the majority, bit by bit, of the 64-bit hashes of a text's shingles; it may have
several such words, from hashes that differ. Equal fingerprints are one point. A vantage-point tree, fitted on a bounded sample of points, deals
all of them into shards of near distance; a point whose ball crosses a border goes to both sides
(only from the inner to the outer one, which suffices for pairs), so that every pair within the
radius meets in a shard. There the same rule splits on until a few hundred points are left, which
are compared in full. Shards give links to the least point of each group, never all pairs, and
alternating stars join these over shards. Points may carry a sketch of their texts' shingles besides:
then a pair is linked only if the sketches agree too.

Defined cases: a null text or one without words has fingerprint zero, linked like any other; fewer
words than a shingle are one shingle; a text of any length is hashed whole; equal rows are linked by
their equal fingerprints; a null key is never the least of its group unless it has no other. An
empty table gives no rows. Columns other than key and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm import vptree
from clickloom.llm.components import components
from clickloom.llm.texts import LOWER, as_bytes, lowest
from clickloom.session import stored

_CHUNK = 1 << 16
#: A shard of more than so many times the wanted points is dealt in pairs of blocks.
OVERFULL = 4

#: The place of a row, under a name that no table has.
_PLACE = "near copies: place"

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        raw = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(
    text: bytes | None, shingle: int = 3, words: int = 1, distinct: bool = False
) -> list[int]:
    """The unsigned fingerprint of one text, in so many words of 64 bits.

    The first word's hashes are XXH64 with seed 42; the others' are mixed from those. Repeated
    shingles count as often as they come, or once each if ``distinct``.
    """
    held = (text or b"").translate(LOWER).split()
    if not held:
        return [0] * words
    if len(held) < shingle:
        grams = [b" ".join(held)]
    elif shingle == 1:
        grams = held
    else:
        grams = [b" ".join(g) for g in zip(*(held[i:] for i in range(shingle)))]
    if distinct:
        grams = set(grams)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(gram, 42) for gram in grams), "<u8", len(grams))
    found = [_majority(hashes)]
    for _ in range(words - 1):
        hashes = (hashes ^ (hashes >> np.uint64(31))) * _MIX[0]
        hashes = (hashes ^ (hashes >> np.uint64(29))) * _MIX[1]
        found.append(_majority(hashes))
    return found


def _multipliers(count: int) -> np.ndarray:
    """Odd numbers that tell the hashes of a sketch's parts apart."""
    return np.random.default_rng(7).integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: bytes | None, shingle: int, words: int) -> list[int]:
    """A sketch of a text's set of shingles, in so many words of sixteen four-bit parts.

    Each part holds four bits of the shingle with the least hash, under a hash of its own: of two
    texts alike by s about s + (1 - s) / 16 of the parts are equal, in whatever order words come.
    """
    held = (text or b"").translate(LOWER).split()
    grams = zip(*(held[i:] for i in range(shingle))) if len(held) >= shingle else [held]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(gram), 42) for gram in grams), "<u8")
    factors = _multipliers(16 * words)
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        mixed = hashes[at : at + (1 << 12), None] * factors
        np.minimum(least, mixed.min(0), out=least)
    parts = ((least >> np.uint64(24)) ^ least) & np.uint64(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.bitwise_or.reduce(parts.reshape(words, 16) << shifts, axis=1).tolist()


def _names(words: int, sketch_words: int = 0) -> list[str]:
    return [f"p{i}" for i in range(words)] + [f"s{i}" for i in range(sketch_words)]


def fingerprints(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    words: int = 1,
    distinct: bool = False,
    mark: Column | None = None,
    sketched: tuple[int, int] | None = None,
) -> DataFrame:
    """Key, mark, the words of the fingerprint (as signed numbers) and its point's number, of every
    row.

    The number of a point is its only word, or a 64-bit hash of its words; the words of a sketch,
    ``sketched`` by its shingle and size, are among them. The mark is a text column over ``docs``,
    null if none is given.
    """
    names = _names(words, sketched[1] if sketched else 0)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            found = [fingerprint(v, shingle, words, distinct) for v in texts]
            if sketched:
                found = [own + sketch(v, *sketched) for own, v in zip(found, texts)]
            signed = np.array(found, np.uint64).reshape(-1, len(names)).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(signed[:, i])) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *columns], ["key", "mark", *names]
            )

    named = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.col(f"`{text}`").alias("text"),
        (F.lit(None).cast("string") if mark is None else mark).alias("mark"),
    )
    schema = ", ".join(f"{name} long" for name in names)
    found = named.mapInArrow(hashed, f"key long, mark string, {schema}")
    return found.withColumn("point", F.xxhash64(*names) if len(names) > 1 else F.col("p0"))


def paired(
    shards: np.ndarray, places: np.ndarray, numbers: np.ndarray, wide: dict[int, int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards and places with their parts: zero, but in a shard of ``wide`` every pair of blocks.

    A point of a shard of n blocks is in one of them by a hash of its number, and goes to the n - 1
    parts that hold this block and another.
    """
    found = [(shards, places, np.zeros(len(shards), np.int64))]
    for shard, blocks in wide.items():
        (kept, at, zero), held = found[0], found[0][0] == shard
        found[0] = (kept[~held], at[~held], zero[~held])
        at = at[held]
        mixed = numbers[at].view(np.uint64) * _MIX[0]
        own = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(blocks)).astype(np.int64)
        for other in range(blocks):
            with_it = own != other
            low, high = np.minimum(own, other)[with_it], np.maximum(own, other)[with_it]
            part = 1 + low * blocks + high
            found.append((np.full(len(part), shard, np.int64), at[with_it], part))
    return tuple(np.concatenate(columns) for columns in zip(*found))


def linked(
    points: DataFrame,
    words: int,
    radius: int,
    most: int,
    shard_points: int,
    sample_points: int,
    sketch_words: int = 0,
    differing: int = 0,
) -> DataFrame:
    """For distinct points (point, p0, ...): links (a, b) that connect all that are near.

    Two are near if any word differs in at most ``radius`` bits and all in at most ``most``, and in
    at most ``differing`` parts of their sketches, if they have any. Each word has a tree of its own. A shard that the tree left far over ``shard_points`` (a dense cluster
    that no border parts) is dealt in blocks of that size, every two of which meet in a task.
    """
    spark = points.sparkSession
    count = points.count()
    depth = 0
    if count > 8 * vptree.LEAF:
        # A level leaves about 0.65 of the points on either side.
        for_size = math.log(max(1.0, count / shard_points)) / math.log(1 / 0.65)
        for_cores = math.log2(2 * spark.sparkContext.defaultParallelism)
        depth = math.ceil(max(for_size, for_cores))
    names = _names(words, sketch_words)
    compared = (words, differing) if sketch_words else None
    sample = lowest(points, "point", sample_points if depth else 0, count)
    fitted = np.array([row[:] for row in sample.select(*names).collect()], np.int64)
    fitted = fitted.reshape(-1, len(names)).view(np.uint64)
    trees = [
        vptree.plan(np.ascontiguousarray(fitted[:, i]), depth, radius) for i in range(words)
    ]

    schema = "word int, shard long, part long, point long, "
    schema += ", ".join(f"{name} long" for name in names)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, tree in enumerate(trees):
                here = batch.column(1 + word).to_numpy().view(np.uint64)
                shards, held = np.unique(vptree.routed(here, tree, radius)[0], return_counts=True)
                words_ = pa.array([word] * len(shards), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [words_, pa.array(shards), pa.array(held.astype(np.int64))],
                    ["word", "shard", "n"],
                )

    chosen = points.select("point", *names)
    parts: dict[tuple[int, int], int] = {}
    if count > OVERFULL * shard_points:
        sizes = chosen.mapInArrow(sized, "word int, shard long, n long").groupBy("word", "shard")
        full = sizes.agg(F.sum("n").alias("n")).filter(F.col("n") > OVERFULL * shard_points)
        parts = {(r.word, r.shard): math.ceil(r.n / shard_points) for r in full.collect()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for word, tree in enumerate(trees):
                here = batch.column(1 + word).to_numpy().view(np.uint64)
                shards, places = vptree.routed(here, tree, radius)
                wide = {shard: n for (at, shard), n in parts.items() if at == word}
                shards, places, pairs = paired(shards, places, numbers, wide)
                for start in range(0, len(places), 20_000):
                    part = pa.array(places[start : start + 20_000])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([word] * len(part), pa.int32()),
                            pa.array(shards[start : start + 20_000]),
                            pa.array(pairs[start : start + 20_000]),
                            *(column.take(part) for column in batch.columns),
                        ],
                        ["word", "shard", "part", "point", *names],
                    )

    def met(here: pd.DataFrame) -> pd.DataFrame:
        word, numbers = int(here["word"].iloc[0]), here["point"].to_numpy()
        held = np.ascontiguousarray(here[names].to_numpy()).view(np.uint64)
        groups = vptree.joined(vptree.links(held, numbers, radius, word, most, compared))
        pairs = [(a, b) for a, b in groups.items() if a != b]
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    shards = chosen.mapInArrow(dealt, schema)
    return shards.groupBy("word", "shard", "part").applyInPandas(met, "a long, b long")


def _rank() -> Column:
    """What orders the rows of a group: by key, null last, then by the text's digest."""
    return F.struct(F.col("key").isNull().alias("unkeyed"), "key", "mark")


def _grouped(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    words: int = 1,
    distinct: bool = False,
    radius: int = 3,
    most: int = 64,
    shard_points: int = 200_000,
    sample_points: int = 8192,
    mark: Column | None = None,
    sketched: tuple[int, int] | None = None,
    differing: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The fingerprints, and every point's component as (point, first): the rank of its first row."""
    found = fingerprints(docs, key, text, shingle, words, distinct, mark, sketched)
    found = stored(found, "prints")
    sketch_words = sketched[1] if sketched else 0
    names = _names(words, sketch_words)
    classes = found.groupBy("point").agg(
        *(F.first(name).alias(name) for name in names), F.min(_rank()).alias("first")
    )
    classes = stored(classes, "print-classes")
    links = linked(
        classes, words, radius, most, shard_points, sample_points, sketch_words, differing
    )
    roots = components(stored(links, "print-links")).withColumnRenamed("node", "point")
    members = stored(classes.select("point", "first").join(roots, "point"), "print-members")
    groups = members.groupBy("root").agg(F.min("first").alias("least"))
    members = members.join(groups, "root").select("point", "least")
    known = classes.select("point", "first").join(members, "point", "left")
    return found, known.select("point", F.coalesce("least", "first").alias("first"))


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """Every row's key, fingerprint (16 hex digits of its first word) and component: the least key
    that it reaches. Options are those of ``_grouped``."""
    found, known = _grouped(docs, **options)
    return found.join(known, "point").select(
        "key",
        F.lpad(F.lower(F.hex("p0")), 16, "0").alias("fingerprint"),
        F.col("first.key").alias("component"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of every group, the one with the least key; columns as they came.

    Of a group's rows with the least key the one with the least MD5 of its text stays, of equal ones
    the first by file and row. A row is known by its place in the files that ``docs`` reads, and only
    by that: rows may share keys and texts. What is not just a read of files is written first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = stored(docs, "near-rows")
    place = F.concat_ws(":", "_metadata.file_path", "_metadata.row_index")
    digest = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    _, known = _grouped(docs, key, text, mark=F.concat(digest, place), **options)
    first = known.select(F.substring("first.mark", 33, 1 << 30).alias("place")).distinct()
    return docs.withColumn(_PLACE, place).join(first, F.col(_PLACE) == first["place"], "left_semi").drop(_PLACE)
