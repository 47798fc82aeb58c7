"""Documents packed into sequences of a fixed length by bounded-space online best-fit.

Each document becomes its ids and an end id. One longer than a sequence is cut into pieces of full
length, of which only the first may be shorter; full pieces are sequences of their own. The rest is
placed online: a fixed number of bins is open, a bitset has a bit for every amount of free space
that some open bin has, and the lowest set bit from the piece's length on is the best fit. Where
none fits, a new bin opens, and if all are open the fullest closes first. Rows are dealt by hash
into groups of about ``group_rows``, each packed by one task that keeps only its open bins; inside a
group longer pieces come first, which wastes least.

Defined cases: a null or empty text is the end id alone; equal rows are separate documents; a text
of any length is taken whole; an empty table gives no row. Columns other than key and text are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.bpe import ROOM, Encoder
from clickloom.session import stored

_ITEMS = "key long, first int, pieces int, crcs array<long>, ids binary"
_PLACED = (
    "key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long,"
    " ids binary"
)


class Bins:
    """The open bins, by free space."""

    def __init__(self, length: int, most_open: int):
        self.length, self.most_open = length, most_open
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits, self.open, self.made = 0, 0, 0

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.length, self.made
            self.made += 1
        left = free - size
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.length - free


def items(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    length: int,
    key: str,
    text: str,
    with_ids: bool,
    room: int = ROOM,
) -> DataFrame:
    """For each document the length of its first piece, the number of pieces and their crc32."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.open(vocabulary, room)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            first, pieces, crcs, kept = [], [], [], []
            for ids in encoder.column(batch.column(1)):
                ids += end
                size = len(ids) // 4
                head = (size - 1) % length + 1
                cuts = [0, *range(4 * head, len(ids) + 1, 4 * length)]
                first.append(head)
                pieces.append(len(cuts) - 1)
                crcs.append([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])])
                kept.append(ids if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(first, pa.int32()),
                    pa.array(pieces, pa.int32()),
                    pa.array(crcs, pa.list_(pa.int64())),
                    pa.array(kept, pa.binary()),
                ],
                ["key", "first", "pieces", "crcs", "ids"],
            )

    named = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")
    )
    return named.mapInArrow(counted, _ITEMS)


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 0,
    length: int = 2048,
    open_bins: int = 16384,
    group_rows: int = 32768,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    room: int = ROOM,
) -> DataFrame:
    """A row for each piece: key, piece, start in the document, length, crc32 of its ids, the
    sequence and the offset there; with its ids (little-endian 32-bit) if asked for."""
    counted = items(docs, vocabulary, end_id, length, key, text, with_ids, room)
    kept = stored(counted.withColumn("row", F.monotonically_increasing_id()), "pack-items")
    groups = max(1, round(kept.count() / group_rows))
    dealt = (
        kept.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
        .repartition(groups, "group")
        .sortWithinPartitions("group", F.desc("first"), "row")
        .drop("row")
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, now = None, None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for name, first, pieces, crcs, ids, group in zip(*columns):
                if group != now:
                    bins, now = Bins(length, open_bins), group
                for piece in range(pieces):
                    start = first + (piece - 1) * length if piece else 0
                    size = length if piece else first
                    number, offset = bins.place(size)
                    part = ids[4 * start : 4 * (start + size)] if ids is not None else None
                    sequence = (group << 40) + number
                    out.append((name, piece, start, size, crcs[piece], sequence, offset, part))
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            names = [field.split()[0] for field in _PLACED.split(", ")]
            lists = [list(values) for values in zip(*out)] if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(lists, types)], names
            )

    found = dealt.mapInArrow(placed, _PLACED)
    return found if with_ids else found.drop("ids")


def sequences(placed: DataFrame) -> DataFrame:
    """Every sequence's ids in a row, from :func:`pack` with ids; a row is bounded by the length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(
        parts, F.lit(b"").cast("binary"), lambda held, part: F.concat(held, part["ids"])
    )
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
