"""Passages of benchmark items inside documents, found by Aho-Corasick automata over words.

Normalising: A-Z to lower case; a word is a run of digits, letters and non-ASCII characters.
Each item gives windows of ``window`` consecutive words; an item of fewer words, but not none, is
one window. All windows form one automaton whose symbols are word numbers, so it takes each text
in one pass and reports every occurrence. Word positions lead back to byte offsets of the original
text. A benchmark of more than ``block_bytes`` of text is taken in several automata, each over the
items of one hash block; a task then passes its batch through each of them, so that neither the
driver nor a broadcast holds more than a block at a time and no window is left out.

Defined cases: a null text or one without words has no words and no hits; null items and items
without words have no window; repeated items count once by id; a null item id marks words but is
in no list of items. A text of any length is taken whole. Empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.texts import as_bytes

#: Bytes of words as they are, in lower case; every other ASCII byte to a space.
WORD_BYTES = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32
    for i in range(256)
)
FOUND = (
    "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:long,end:long>>>"
)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def windows(text: bytes, window: int) -> set[tuple[bytes, ...]]:
    """The windows of one item."""
    words = text.translate(WORD_BYTES).split()
    if len(words) <= window:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + window]) for i in range(len(words) - window + 1)}


class Matcher:
    """One automaton over the windows of a block of items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        owners: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in items:
            for held in windows(text.encode(), window):
                owners[held].add(item)
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for held, items_of in owners.items():
            key = tuple(self.numbers.setdefault(word, len(self.numbers) + 1) for word in held)
            self.automaton.add_word(key, (len(key), items_of - {None}))
        if owners:
            self.automaton.make_automaton()
        self.shortest = min(map(len, owners), default=0)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set]]:
        """Start, end (exclusive) and items of each occurrence, by end."""
        if not self.shortest or len(words) < self.shortest:
            return
        number = self.numbers.get
        for last, (length, items) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            yield last + 1 - length, last + 1, items


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _offsets(text: bytes, wanted: list[tuple[int, int]]) -> list[dict]:
    """Byte offsets in the original text of ranges of words."""
    plain, places, at = text.translate(WORD_BYTES), [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in wanted]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """The documents with a struct column ``found``: words, hit words, items
    (ids as strings, in order) and hit spans (byte offsets of the text as UTF-8)."""
    spark = docs.sparkSession
    items = benchmark.select(
        F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text")
    ).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    block = F.pmod(F.xxhash64("text"), F.lit(blocks))
    shared = [
        spark.sparkContext.broadcast(
            [tuple(row) for row in items.filter(block == number).toLocalIterator()]
        )
        for number in range(blocks)
    ]
    rest = [c for c in docs.columns if c != "found"]
    at = rest.index(text)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in rest)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Matcher(shared[0].value, window) if len(shared) == 1 else None
        for batch in batches:
            texts = as_bytes(batch.column(at))
            split = [(value or b"").translate(WORD_BYTES).split() for value in texts]
            hits: dict[int, list] = defaultdict(list)
            owners: dict[int, set] = defaultdict(set)
            for one in shared:
                matcher = only or Matcher(one.value, window)
                for row, words in enumerate(split):
                    for start, end, held in matcher.search(words):
                        hits[row].append((start, end))
                        owners[row] |= held
            ranges = {row: _merged(found) for row, found in hits.items()}
            found = pa.StructArray.from_arrays(
                [
                    pa.array(map(len, split), pa.int64()),
                    pa.array(
                        [sum(b - a for a, b in ranges.get(i, ())) for i in range(len(split))],
                        pa.int64(),
                    ),
                    pa.array(
                        [sorted(owners.get(i, ())) for i in range(len(split))],
                        pa.list_(pa.string()),
                    ),
                    pa.array(
                        [
                            _offsets(texts[i], ranges[i]) if i in ranges else []
                            for i in range(len(split))
                        ],
                        _SPAN,
                    ),
                ],
                ["n_words", "n_hit", "items", "spans"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*rest, "found"])

    kept = docs.select(*(F.col(f"`{c}`") for c in rest))
    return kept.mapInArrow(scanned, f"{schema}, found {FOUND}")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no passage of the benchmark, columns as they came."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text)]
    found = scan(docs.toDF(*names), benchmark, text=at, **options).filter("found.n_hit = 0")
    return found.select(*names).toDF(*docs.columns)
