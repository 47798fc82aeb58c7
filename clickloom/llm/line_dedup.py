"""Lines that many documents share, found and dropped, with an index that can be undone.

A line's key is the line without white space (space, bytes 9 to 13) at both ends, A-Z in lower
case. The index counts, for every key, the documents that hold it: exact reference counts, which
grow by ``insert`` and shrink by ``delete``. Keys at or over the threshold also sit in cuckoo
filters, one for each shard of keys; these answer for the lines of a document inside the task that
reads it, so that no line is shuffled. The keys a filter would answer wrongly are known from the
reference counts and travel with it, hence the answer is exact for every indexed document. Where
filters outgrow ``broadcast_bytes`` the lines are joined with the reference counts instead.

Defined cases: a null or empty text is one empty line, whose key is empty and never dropped.
Equal rows are separate documents. A line of any length is hashed whole (128 bits). An empty table
gives an empty index and an empty result. Other columns of the documents pass through untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.cuckoo import CuckooFilter, built
from clickloom.llm.texts import LOWER, SPACE, as_bytes, as_text
from clickloom.session import stored

KEYS_PER_SHARD = 1 << 16
_COUNTS = "key binary, n_docs long"
_FILTERS = "shard int, size int, content binary"


def line_keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The 128-bit key of each line of a text, or nothing for a key that is too short."""
    keys = []
    for line in (text or b"").translate(LOWER).split(b"\n"):
        line = line.strip(SPACE)
        short = len(line) < min_chars or (min_chars > 1 and len(line.decode()) < min_chars)
        keys.append(None if short else xxhash.xxh3_128_digest(line))
    return keys


def count_lines(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """For every key the number of documents with it; counted by batch before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for value in as_bytes(batch.column(0)):
                held.update(set(line_keys(value, min_chars)))
            held.pop(None, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                ["key", "n_docs"],
            )

    keys = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(counted, _COUNTS)
    return keys.groupBy("key").agg(F.sum("n_docs").alias("n_docs"))


def _shard(shards: int):
    return F.conv(F.hex(F.substring("key", 9, 2)), 16, 10).cast("int") % F.lit(shards)


def _words(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and shard number (before the remainder) of keys."""
    joined = b"".join(keys)
    return np.frombuffer(joined, "<u8")[::2], np.frombuffer(joined, ">u2")[4::8]


class _Known:
    """The filters of all shards and the keys they would answer wrongly."""

    def __init__(self, filters: dict[int, bytes], wrong: set[bytes], shards: int):
        self.filters = {k: CuckooFilter.from_bytes(v) for k, v in filters.items()}
        self.wrong, self.shards = wrong, shards

    def has(self, keys: list[bytes]) -> np.ndarray:
        hashes, shards = _words(keys)
        shards = shards % self.shards
        found = np.zeros(len(keys), bool)
        for shard, held in self.filters.items():
            here = np.flatnonzero(shards == shard)
            found[here] = held.contains(hashes[here])
        if self.wrong:
            for i in np.flatnonzero(found):
                found[i] = keys[i] not in self.wrong
        return found


@dataclass(frozen=True)
class LineIndex:
    """Exact reference counts of line keys and a cuckoo filter for each shard of frequent keys."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    threshold: int
    min_chars: int
    text: str

    @staticmethod
    def build(
        docs: DataFrame, threshold: int = 10, min_chars: int = 1, text: str = "text"
    ) -> "LineIndex":
        counts = stored(count_lines(docs, text, min_chars), "line-counts")
        frequent = counts.filter(F.col("n_docs") >= threshold)
        shards = min(1 << 16, max(8, -(-frequent.count() // KEYS_PER_SHARD)))
        filters = (
            frequent.select(_shard(shards).alias("shard"), "key")
            .groupBy("shard")
            .applyInPandas(_filled, _FILTERS)
        )
        return LineIndex(
            counts, stored(filters, "line-filters"), shards, threshold, min_chars, text
        )

    def insert(self, docs: DataFrame) -> "LineIndex":
        """The index after these documents came."""
        return self._changed(count_lines(docs, self.text, self.min_chars))

    def delete(self, docs: DataFrame) -> "LineIndex":
        """The index after these documents, all of them in it, went."""
        gone = count_lines(docs, self.text, self.min_chars)
        return self._changed(gone.select("key", (-F.col("n_docs")).alias("n_docs")))

    def _changed(self, change: DataFrame) -> "LineIndex":
        both = self.counts.select("key", "n_docs", F.lit(0).alias("more")).unionByName(
            change.select("key", F.lit(0).alias("n_docs"), F.col("n_docs").alias("more"))
        )
        summed = stored(
            both.groupBy("key").agg(F.sum("n_docs").alias("was"), F.sum("more").alias("more")),
            "line-counts",
        )
        now = F.col("was") + F.col("more")
        before, after = F.col("was") >= self.threshold, now >= self.threshold
        crossed = summed.filter(before != after).select(
            _shard(self.shards).alias("shard"), "key", after.cast("int").alias("role")
        )
        entering = crossed.groupBy("shard").agg(F.sum("role").alias("entering"))
        slots = F.coalesce(F.length("content") / 4, F.lit(float(CuckooFilter(0).table.size)))
        full = (
            self.filters.join(entering, "shard", "right")
            .filter(F.coalesce("size", F.lit(0)) + F.col("entering") > 0.8 * slots)
            .select("shard")
        )
        anew = summed.filter(after).select(
            _shard(self.shards).alias("shard"), "key", F.lit(2).alias("role")
        )
        keys = crossed.unionByName(anew.join(full, "shard", "left_semi"))
        filters = (
            self.filters.groupBy("shard")
            .cogroup(keys.groupBy("shard"))
            .applyInPandas(_updated, _FILTERS)
        )
        return replace(
            self,
            counts=summed.filter(now > 0).select("key", now.alias("n_docs")),
            filters=stored(filters, "line-filters"),
        )

    def strip(self, docs: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
        """The documents without the lines that are frequent now.

        Adds ``n_lines`` (before dropping) and ``n_dropped``; the text column holds the rest.
        The documents must be among those counted.
        """
        size = self.filters.agg(F.sum(F.length("content"))).first()[0] or 0
        if size <= broadcast_bytes:
            return self._strip_by_filter(docs)
        return self._strip_by_join(docs)

    def _strip_by_filter(self, docs: DataFrame) -> DataFrame:
        context = docs.sparkSession.sparkContext
        filters = {r.shard: bytes(r.content) for r in self.filters.toLocalIterator()}
        rare = self.counts.filter(F.col("n_docs") < self.threshold).select("key")
        alone = context.broadcast((filters, set(), self.shards))
        # About two of 10^9 rare keys pass a filter.
        wrong = rare.mapInArrow(lambda batches: _passing(batches, alone), "key binary")
        shared = context.broadcast(
            (filters, {bytes(r.key) for r in wrong.toLocalIterator()}, self.shards)
        )
        min_chars = self.min_chars

        def opened():
            known = _Known(*shared.value)

            def drops(texts: list[bytes | None], _: list) -> Iterator[list[bool]]:
                keys = [line_keys(value, min_chars) for value in texts]
                flat = [key for one in keys for key in one if key]
                found = iter(known.has(flat).tolist())
                for one in keys:
                    yield [bool(key) and next(found) for key in one]

            return drops

        return self._stripped(docs, F.lit(None).cast("array<binary>"), opened)

    def _strip_by_join(self, docs: DataFrame) -> DataFrame:
        """The same by joins; the join of hot lines and of hot texts is split by Spark."""
        min_chars = self.min_chars
        whole = F.md5(F.coalesce(F.col(f"`{self.text}`"), F.lit("")).cast("binary"))

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = {
                    (name, key)
                    for name, value in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)))
                    for key in line_keys(value, min_chars)
                    if key
                }
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name for name, _ in held], pa.string()),
                        pa.array([key for _, key in held], pa.binary()),
                    ],
                    ["whole", "key"],
                )

        lines = docs.select(whole.alias("whole"), F.col(f"`{self.text}`").alias("text"))
        lines = lines.mapInArrow(listed, "whole string, key binary").distinct()
        frequent = self.counts.filter(F.col("n_docs") >= self.threshold).select("key")
        hits = lines.join(frequent, "key").groupBy("whole").agg(F.collect_list("key").alias("keys"))
        named = docs.select(F.struct("*").alias("row"), whole.alias("whole"))
        joined = named.join(hits, "whole", "left")

        def drops(texts: list[bytes | None], gone: list) -> Iterator[list[bool]]:
            for value, keys in zip(texts, gone):
                held = set(keys or ())
                yield [key in held for key in line_keys(value, min_chars)]

        flat = joined.select("row.*", F.col("keys").alias("__keys"))
        return self._stripped(flat, F.col("__keys"), lambda: drops)

    def _stripped(self, docs: DataFrame, gone, opened) -> DataFrame:
        rest = [c for c in docs.columns if c not in ("__keys", "n_lines", "n_dropped")]
        at = rest.index(self.text)
        fields = {f.name: f for f in docs.schema.fields}
        schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in rest)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drops = opened()
            for batch in batches:
                texts = as_bytes(batch.column(at))
                out, n_lines, n_dropped = [], [], []
                for value, flags in zip(texts, drops(texts, batch.column(len(rest)).to_pylist())):
                    n_lines.append(len(flags))
                    n_dropped.append(sum(flags))
                    if n_dropped[-1]:
                        lines = zip(value.split(b"\n"), flags)
                        value = b"\n".join(line for line, drop in lines if not drop)
                    out.append(value or b"")
                columns = list(batch.columns[: len(rest)])
                columns[at] = as_text(out)
                columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*rest, "n_lines", "n_dropped"])

        wanted = docs.select(*(F.col(f"`{c}`") for c in rest), gone.alias("__gone"))
        return wanted.mapInArrow(kept, f"{schema}, n_lines long, n_dropped long")


def _passing(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    known = _Known(*shared.value)
    for batch in batches:
        keys = batch.column(0).to_pylist()
        held = [keys[i] for i in np.flatnonzero(known.has(keys))]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["key"])


def _row(shard: int, held: CuckooFilter) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "size": [held.size], "content": [held.to_bytes()]})


def _filled(keys: pd.DataFrame) -> pd.DataFrame:
    return _row(int(keys.shard.iloc[0]), built(_words(keys.key.tolist())[0]))


def _updated(key: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after keys left (role 0) and came (1), or made anew from all (2)."""
    hashes, role = _words(keys.key.tolist())[0], keys.role.to_numpy()
    if (role == 2).any():
        return _row(key[0], built(hashes[role == 2]))
    held = CuckooFilter.from_bytes(old.content.iloc[0]) if len(old) else CuckooFilter(0)
    held.delete(hashes[role == 0])
    held.insert(hashes[role == 1])
    return _row(key[0], held)
