"""Byte-level byte-pair ids by the tiktoken library, long texts in overlapping chunks.

A text longer than a chunk is cut into chunks of ``chunk_chars`` characters, each with the first
``overlap`` characters of what follows, and every chunk is pre-tokenised by itself, wherever Spark
puts it. A chunk starts anywhere, so its first pre-tokens may be wrong; but a pre-token depends
only on the text from its start on. Where a boundary of one chunk is also one of the next, both go
on alike, and the text is stitched there: the chunk ends and the next one begins. Two chunks
whose overlap holds no common boundary (a run of letters longer than it) are made one chunk
and read again, until every seam is found. The pieces between the seams are then encoded chunk by
chunk. Decoding concatenates the bytes of the ids.

Defined cases: a null text counts as empty, an empty text has no ids; a null key stays null; equal
rows and equal keys are separate documents; a text of any length is taken whole, a single pre-token
of any length by one task; an empty table gives no row. Columns other than key and text are not
read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.session import stored

_PARTS = "row long, key long, chunk long, ids binary"
_DIGESTS = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: How many characters past its end can decide where a pre-token of the pattern ends ("'ll").
LOOKAHEAD = 3


def _ranges(characters: str) -> str:
    """Characters in ascending order as the inside of a character class."""
    codes = np.fromiter(map(ord, characters), np.int64)
    breaks = np.flatnonzero(np.diff(codes) > 1)
    lows = codes[np.concatenate([[0], breaks + 1])]
    highs = codes[np.concatenate([breaks, [len(codes) - 1]])]
    return "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in zip(lows, highs))


def _classes(pattern: str, below: int) -> re.Pattern:
    """The pattern with its classes spelled out as the library's own tables have them.

    Letters and digits differ between versions of Unicode, and white space between engines, so the
    library is asked: all characters are given to it with the class as its pattern.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, below)]))
    ranks = {bytes([i]): i for i in range(256)}

    def members(name: str) -> str:
        asked = tiktoken.Encoding("asked", pat_str=name, mergeable_ranks=ranks, special_tokens={})
        return _ranges(bytes(asked.encode_ordinary(every)).decode())

    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|\[\^?|.", pattern, re.S):
        if part in (r"\s", r"\S") or part.startswith(r"\p"):
            held = members(part.lower() if part == r"\S" else part)
            out.append(held if inside else f"[^{held}]" if part == r"\S" else f"[{held}]")
        else:
            inside = part[0] == "[" or (inside and part != "]")
            out.append(part)
    return re.compile("".join(out))


class _Merged(dict):
    """The ids of pre-tokens, each merged when it is first met."""

    def __init__(self, model: tiktoken.Encoding):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = np.array(self.model._encode_single_piece(piece), "<u4").tobytes()
        return ids


class Coder:
    """Pre-tokens, ids and bytes for one file of ranks."""

    _open: dict[tuple[str, str], "Coder"] = {}

    def __init__(self, ranks: str, pattern: str, room: int = 200_000):
        with open(ranks, "rb") as lines:
            pairs = (line.split() for line in lines)
            held = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.model = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=held, special_tokens={}
        )
        self.bytes_of = [b""] * (max(held.values()) + 1)
        for token, rank in held.items():
            self.bytes_of[rank] = token
        # Characters above 0xFFFF are rare, and a class without them is looked up faster.
        self.plain, self.wide = _classes(pattern, 0x10000), _classes(pattern, 0x110000)
        self.room = room
        self.ids_of = _Merged(self.model)

    @classmethod
    def open(cls, ranks: str, pattern: str) -> "Coder":
        """One for each worker, so that known pieces serve all its tasks."""
        if (ranks, pattern) not in cls._open:
            cls._open[ranks, pattern] = cls(ranks, pattern)
        return cls._open[ranks, pattern]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text. The pattern leaves no character out."""
        wide = not text.isascii() and len(text.encode("utf-16-le")) > 2 * len(text)
        return (self.wide if wide else self.plain).findall(text)

    def encode(self, pieces: list[str]) -> bytes:
        """The ids of pre-tokens, little-endian unsigned 32-bit, each piece merged by itself."""
        known = self.ids_of
        if len(known) > self.room:
            known.clear()
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def _batch(schema: str, *columns: list) -> pa.RecordBatch:
    kinds = {
        "long": pa.int64(),
        "string": pa.string(),
        "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()),
    }
    fields = [field.split() for field in schema.split(", ")]
    arrays = [pa.array(values, kinds[kind]) for values, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _whole(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Documents of one chunk: nothing to stitch."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.open(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few = batch.slice(at, 512)
                texts, keys = few.column(1).to_pylist(), few.column(0).to_pylist()
                ids = [coder.encode(coder.pieces(text)) if text else b"" for text in texts]
                yield _batch(_PARTS, [None] * len(ids), keys, [0] * len(ids), ids)

    return docs.mapInArrow(coded, _PARTS)


def _cut(docs: DataFrame, chunk_chars: int) -> DataFrame:
    """A row for each chunk of a text, without the overlap; ``start`` in characters."""
    schema = "row long, key long, chunk long, start long, body string"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, key, text in zip(*(batch.column(i) for i in range(3))):
                text = text.as_py()
                starts = list(range(0, len(text), chunk_chars))
                count = len(starts)
                bodies = [text[at : at + chunk_chars] for at in starts]
                ids = [row.as_py()] * count, [key.as_py()] * count
                yield _batch(schema, *ids, list(range(count)), starts, bodies)

    return docs.mapInArrow(chunks, schema)


def _overlapped(chunks: DataFrame, overlap: int) -> DataFrame:
    """Each chunk with the beginning of the next, and whether there is one.

    A text's chunks are numbered without gaps, so the next one is found by an equality join, and
    the chunks of one text need not meet in one task.
    """
    heads = chunks.select(
        "row", (F.col("chunk") - 1).alias("chunk"), F.substring("body", 1, overlap).alias("after")
    )
    return chunks.join(heads, ["row", "chunk"], "left")


def _pretokenised(chunks: DataFrame, ranks: str, pattern: str, overlap: int) -> DataFrame:
    """Each chunk's own view of the boundaries: ``ends`` of its pre-tokens, and, as places in the
    text, the boundaries near its start (``head``) and the settled ones past its end (``tail``)."""
    schema = (
        "row long, key long, chunk long, start long, text string, ends binary,"
        " head array<long>, tail array<long>"
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.open(ranks, pattern)
        for batch in batches:
            for row, key, chunk, start, body, after in zip(
                *(batch.column(i) for i in range(batch.num_columns))
            ):
                first, own, after = start.as_py(), body.as_py(), after.as_py()
                text = own + (after or "")
                ends = np.fromiter(accumulate(map(len, coder.pieces(text))), np.int64)
                places = np.concatenate([[0], ends])
                head = places[places < overlap] + first
                past = (places >= len(own)) & (places <= len(text) - LOOKAHEAD)
                tail = places[past] + first if after is not None else places[:0]
                yield _batch(
                    schema,
                    [row.as_py()],
                    [key.as_py()],
                    [chunk.as_py()],
                    [first],
                    [text],
                    [ends.astype("<i8").tobytes()],
                    [head.tolist()],
                    [tail.tolist()],
                )

    return chunks.select("row", "key", "chunk", "start", "body", "after").mapInArrow(split, schema)


def _merged(chunks: DataFrame, open_seams: DataFrame) -> DataFrame:
    """Chunks on both sides of an open seam as one, and all numbered anew.

    What one group gathers is a stretch of one text, which was one value before it was cut.
    """
    before = open_seams.groupBy("row").agg(
        F.array_sort(F.collect_list(F.col("chunk") + 1)).alias("gone")
    )
    numbered = chunks.join(before, "row").withColumn(
        "chunk", F.col("chunk") - F.size(F.filter("gone", lambda g: g <= F.col("chunk")))
    )
    parts = F.array_sort(F.collect_list(F.struct("start", "body")))
    joined = F.array_join(F.transform(parts, lambda part: part["body"]), "")
    again = numbered.groupBy("row", "key", "chunk").agg(
        F.min("start").alias("start"), joined.alias("body")
    )
    return again.unionByName(chunks.join(before, "row", "left_anti").select(again.columns))


def _stitched(
    docs: DataFrame, ranks: str, pattern: str, chunk_chars: int, overlap: int
) -> DataFrame:
    """Chunks with ``text``, ``ends`` and the seams they lie between, ``low`` and ``high``."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "key", "text")
    chunks = stored(_cut(numbered, chunk_chars), "bpe-chunks")
    while True:
        seen = stored(
            _pretokenised(_overlapped(chunks, overlap), ranks, pattern, overlap), "bpe-ends"
        )
        following = seen.select("row", (F.col("chunk") - 1).alias("chunk"), F.col("head").alias("to"))
        seams = stored(
            seen.select("row", "chunk", "tail")
            .join(following, ["row", "chunk"])
            .select("row", "chunk", F.array_min(F.array_intersect("tail", "to")).alias("seam")),
            "bpe-seams",
        )
        unsettled = seams.where("seam IS NULL")
        if unsettled.isEmpty():
            break
        chunks = stored(_merged(chunks, unsettled), "bpe-chunks")
    high = seams.select("row", "chunk", F.col("seam").alias("high"))
    low = seams.select("row", (F.col("chunk") + 1).alias("chunk"), F.col("seam").alias("low"))
    return (
        seen.drop("head", "tail")
        .join(high, ["row", "chunk"], "left")
        .join(low, ["row", "chunk"], "left")
    )


def _parts(stitched: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The ids of each chunk's pieces between its seams."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.open(ranks, pattern)
        for batch in batches:
            rows, keys, chunks, *rest = (batch.column(i) for i in range(batch.num_columns))
            ids = []
            for start, text, ends, low, high in zip(*rest):
                start, text = start.as_py(), text.as_py()
                first = (low.as_py() or start) - start
                last = len(text) if high.as_py() is None else high.as_py() - start
                places = np.frombuffer(ends.as_py(), "<i8")
                cuts = [first, *places[(places > first) & (places <= last)].tolist()]
                ids.append(coder.encode([text[a:b] for a, b in zip(cuts, cuts[1:])]))
            yield _batch(_PARTS, rows.to_pylist(), keys.to_pylist(), chunks.to_pylist(), ids)

    names = ["row", "key", "chunk", "start", "text", "ends", "low", "high"]
    return stitched.select(*names).mapInArrow(coded, _PARTS)


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str = public_tokenizers.PATTERN,
    chunk_chars: int = 1 << 16,
    overlap: int = 1 << 10,
    key: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The ids of every text: documents of one chunk, and the parts of longer ones by ``row`` and
    ``chunk``. Both have the columns row (null for whole documents), key, chunk and ids."""
    if overlap <= LOOKAHEAD or chunk_chars <= overlap:
        raise ValueError("a chunk must be longer than the overlap, and that than the lookahead")
    named = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    fits = F.length("text") <= chunk_chars
    whole = _whole(named.where(fits), ranks, pattern)
    long = _stitched(named.where(~fits), ranks, pattern, chunk_chars, overlap)
    return whole, _parts(long, ranks, pattern)


def digests(
    whole: DataFrame, parts: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """For each document the number of its ids, and the sha256 of the ids in decimals and of the
    bytes they decode to. The parts of a document are read in order, one at a time."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.open(ranks, pattern)

        def every() -> Iterator[tuple[int, int | None, bytes]]:
            # Whole documents have no row number: each is one of its own.
            for at, batch in enumerate(batches):
                rows, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for n, (row, name, ids) in enumerate(zip(rows, keys, batch.column(3))):
                    yield (at, n) if row is None else row, name, ids.as_py()

        held: list[tuple] = []
        for _, group in groupby(every(), key=lambda part: part[0]):
            shown, decoded, count, name = hashlib.sha256(), hashlib.sha256(), 0, None
            for _, name, content in group:
                ids = np.frombuffer(content, "<u4")
                if len(ids):
                    shown.update(("," if count else "").encode())
                    shown.update(",".join(map(str, ids.tolist())).encode())
                    decoded.update(coder.decode(ids))
                    count += len(ids)
            held.append((name, count, shown.hexdigest(), decoded.hexdigest()))
            if len(held) == 4096:
                yield _batch(_DIGESTS, *zip(*held))
                held = []
        if held:
            yield _batch(_DIGESTS, *zip(*held))

    ordered = parts.repartition("row").sortWithinPartitions("row", "chunk")
    return whole.mapInArrow(summed, _DIGESTS).unionAll(ordered.mapInArrow(summed, _DIGESTS))
