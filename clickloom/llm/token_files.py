"""Token ids in binary files of fixed-width bits, and their way back.

A file holds whole documents, at least one and about ``file_ids`` ids, as little-endian numbers::

    magic "TKB1" | width u1 | 3 zero bytes | part u4 | shard u4
    documents u8 | ids u8 | ids to a block u8 | blocks u8
    keys i8 x documents | key is null u1 x documents | first id u8 x (documents + 1)
    block offsets u8 x (blocks + 1)
    blocks: each id in ``width`` bits, the least that the vocabulary needs, low bits first
    one line feed

Files are numbered (part, shard) in the order of the keys, and a part is a range of keys. Any id is
reached by its block; blocks unpack in numpy without a loop. Files are written and read by Spark's
own writers and readers, hence in any store it knows; a task that is run again replaces its files.

Defined cases: a null text counts as empty and gives the end id alone; a null key comes first;
equal keys are separate documents, in the order of their texts. A document longer than a file is
one larger file. An empty table gives no file and no row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.bpe import Encoder

MAGIC = b"TKB1"
_HEAD = struct.Struct("<4sB3xIIQQQQ")
_FILES = "part int, shard int, content binary"
_READ = "part int, shard int, place long, key long, first long, ids binary"


def packed(ids: np.ndarray, width: int) -> bytes:
    """Ids in so many bits each, low bits first."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpacked(content: bytes, count: int, width: int) -> np.ndarray:
    """The first ids of a packed block."""
    if width == 16:
        return np.frombuffer(content, "<u2", count).astype("<u4")
    bits = np.unpackbits(np.frombuffer(content, np.uint8), bitorder="little")[: count * width]
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :width] = bits.reshape(count, width)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def file_bytes(part, shard, keys: list[int | None], docs: list[np.ndarray], width, block) -> bytes:
    """One file, without its line feed."""
    ids = np.concatenate(docs)
    blocks = [packed(ids[i : i + block], width) for i in range(0, len(ids), block)]
    return b"".join(
        [
            _HEAD.pack(MAGIC, width, part, shard, len(docs), len(ids), block, len(blocks)),
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.array([k is None for k in keys], np.uint8).tobytes(),
            np.cumsum([0, *map(len, docs)], dtype="<u8").tobytes(),
            np.cumsum([0, *map(len, blocks)], dtype="<u8").tobytes(),
            *blocks,
        ]
    )


class TokenFile:
    """A file's content: its documents, and any range of ids by the blocks that hold it."""

    def __init__(self, content: bytes):
        magic, self.width, self.part, self.shard, docs, self.size, self.block, blocks = (
            _HEAD.unpack_from(content)
        )
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        keys = np.frombuffer(content, "<i8", docs, at)
        null = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
        self.keys = [None if n else int(k) for k, n in zip(keys, null)]
        at += 9 * docs
        self.first = np.frombuffer(content, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.offsets = np.frombuffer(content, "<u8", blocks + 1, at).astype(np.int64)
        self.start, self.content = at + 8 * (blocks + 1), memoryview(content)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` up to ``end``, reading only the blocks they are in."""
        if start >= end:
            return np.zeros(0, "<u4")
        parts = []
        for number in range(start // self.block, (end - 1) // self.block + 1):
            low = number * self.block
            held = self.content[
                self.start + self.offsets[number] : self.start + self.offsets[number + 1]
            ]
            ids = unpacked(held, min(self.block, self.size - low), self.width)
            parts.append(ids[max(start - low, 0) : end - low])
        return np.concatenate(parts)

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.first[number]), int(self.first[number + 1]))


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    file_ids: int = 1 << 20,
    block_ids: int = 1 << 14,
) -> None:
    """Encode every document, put ``end_id`` after it and write files in ascending key order."""
    ordered = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")
    )
    ordered = ordered.repartitionByRange("key").sortWithinPartitions("key", "text")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.open(vocabulary)
        part, shard = TaskContext.get().partitionId(), 0
        width = max(1, int(max(encoder.vocabulary - 1, end_id)).bit_length())
        end = np.array([end_id], "<u4").tobytes()
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def done() -> pa.RecordBatch:
            content = file_bytes(part, shard, keys, held, width, block_ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([shard], pa.int32()),
                    pa.array([content], pa.binary()),
                ],
                ["part", "shard", "content"],
            )

        for batch in batches:
            for name, coded in zip(batch.column(0).to_pylist(), encoder.column(batch.column(1))):
                ids = np.frombuffer(coded + end, "<u4")
                if held and size + len(ids) > file_ids:
                    yield done()
                    shard, keys, held, size = shard + 1, [], [], 0
                keys.append(name)
                held.append(ids)
                size += len(ids)
        if held:
            yield done()

    # The text writer puts the bytes down as they are, and a line feed after them.
    (
        ordered.mapInArrow(files, _FILES)
        .select(F.col("content").cast("string"))
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all files: part, shard, place in the file, key, first id there, and ids
    as little-endian unsigned 32-bit integers."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held = TokenFile(content.as_py())
                count = len(held.keys)
                whole = held.ids(0, held.size)
                cut = zip(held.first.tolist(), held.first[1:].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held.part] * count, pa.int32()),
                        pa.array([held.shard] * count, pa.int32()),
                        pa.array(range(count), pa.int64()),
                        pa.array(held.keys, pa.int64()),
                        pa.array(held.first[:-1], pa.int64()),
                        pa.array([whole[a:b].tobytes() for a, b in cut], pa.binary()),
                    ],
                    ["part", "shard", "place", "key", "first", "ids"],
                )

    # Given by hand, so that a folder without a file is an empty table.
    schema = T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("modificationTime", T.TimestampType()),
            T.StructField("length", T.LongType()),
            T.StructField("content", T.BinaryType()),
        ]
    )
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "part-*")
    return files.load(path).select("content").mapInArrow(documents, _READ)


def with_starts(docs: DataFrame) -> DataFrame:
    """Rows of :func:`read` (or what is left of them, with ``n_tokens``) and ``start``: the ids of
    all documents before. Sums by file come first, then by part: no task sees more than those."""
    files = docs.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    parts = parts.select("part", before.alias("of_part"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(
        "part", "shard", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("of_file")
    )
    starts = files.join(parts, "part").select(
        "part", "shard", (F.col("of_part") + F.col("of_file")).alias("before")
    )
    joined = docs.join(starts, ["part", "shard"])
    return joined.withColumn("start", F.col("before") + F.col("first")).drop("before")
