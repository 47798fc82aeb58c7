"""Words that differ by one letter, found in tries of letter counts, and the form each stands for.

Letters fall into groups by code point, and a word is the vector of its counts per group. One
inserted, deleted or replaced letter moves one unit at most: two near words differ by a surplus of
at most one and a deficit of at most one over all groups. Words are arranged as a trie by their
counts in one group after another, groups with the most spread first; a depth-first search carries
the words looked for down the trie, each with what is left of its budget, and the words of the
leaves it reaches are verified letter by letter.

The first levels of the trie are Spark's: a word is stored in the shard of its first counts and
looked for there and in the shards that the budget reaches, each pair of shards one way only. So a
pair is found once. A shard is one task's trie, of bounded size: a larger one is dealt into blocks of
stored words and of words looked for, and every block meets every other. Shards grow in number
with the vocabulary.

Defined cases: null words are left out; repeated words of :func:`group` are taken together, their
counts added; a word without near words has none for a form and is its own root; ties of counts go
to the word first in code-point order; an empty table gives no row. Texts that are null or hold no
word give none; texts and words of any length are taken whole. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.session import stored

#: Groups of letters: code points modulo this, so that a to z have a group each.
GROUPS = 32
#: A node of so few words is not divided further.
LEAF = 32
#: Longer words are verified one by one rather than in a padded table.
WIDE = 64
_ROUTED = "shard binary, word string, n long, role int"
_PAIRS = "word string, n long, other string, other_n long"
_STORED, _OWN, _SENT = 0, 1, 2


def runs(
    docs: DataFrame, letters: str, min_chars: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every longest run of at least so many of these letters, with its document's key, A-Z in
    lower case. ``letters`` is the inside of a character class."""
    # Possessive: a run is taken whole or not at all.
    found = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{letters}]{{{min_chars},}}+"), 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return docs.select(F.col(f"`{key}`").alias("key"), F.explode(found).alias("word")).select(
        "key", F.translate("word", upper, upper.lower()).alias("word")
    )


def without(word: Column, place: Column) -> Column:
    """A word without its letter at a place, from 0."""
    return F.concat(
        F.substring(word, F.lit(1), place.cast("int")),
        F.substring(word, (place + 2).cast("int"), F.length(word)),
    )


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, one after the other, and each word's length."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return codes, np.fromiter(map(len, words), np.int64, len(words))


def vectors(words: list[str], order: list[int]) -> np.ndarray:
    """Each word's counts per group, the groups in the given order."""
    codes, lengths = _codes(words)
    place = np.empty(GROUPS, np.int64)
    place[order] = np.arange(GROUPS)
    cells = np.repeat(np.arange(len(words)) * GROUPS, lengths) + place[codes % GROUPS]
    counts = np.bincount(cells, minlength=len(words) * GROUPS)
    return counts.reshape(-1, GROUPS).astype(np.int32)


def _marks(counts: np.ndarray) -> np.ndarray:
    """Two bits a group, for counts from one and from two on, in one number."""
    bits = np.concatenate([counts >= 1, counts >= 2], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def _spread(words: DataFrame) -> list[int]:
    """The groups, the most frequent first: 32 sums."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter"))
    sums = letters.groupBy((F.ascii("letter") % GROUPS).alias("group")).count().collect()
    count = {row.group: row["count"] for row in sums}
    return sorted(range(GROUPS), key=lambda group: (-count.get(group, 0), group))


def _moves(levels: int) -> np.ndarray:
    """What the budget can change in the first counts, each change or its opposite but not both."""
    one = np.eye(levels, dtype=np.int64)
    swaps = [one[i] - one[j] for i, j in itertools.combinations(range(levels), 2)]
    return np.array([*one, *swaps])


def _routed(words: DataFrame, order: list[int], levels: int) -> DataFrame:
    """Words by shard: stored, looked for in the own shard, and sent to others."""
    moves = _moves(levels)

    def routes(batches):
        for batch in batches:
            words, counts = batch.column(0), batch.column(1)
            first = vectors(words.to_pylist(), order)[:, :levels].astype(np.int64)
            for role, move in [(_STORED, None), (_OWN, None), *((_SENT, m) for m in moves)]:
                target = first if move is None else first + move
                kept = np.flatnonzero((target >= 0).all(axis=1))
                raw = np.ascontiguousarray(target[kept].astype(">u4"))
                offsets = np.arange(len(kept) + 1, dtype=np.int32) * (4 * levels)
                shards = pa.Array.from_buffers(
                    pa.binary(),
                    len(kept),
                    [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())],
                )
                taken = pa.array(kept)
                roles = pa.array(np.full(len(kept), role, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [shards, words.take(taken), counts.take(taken), roles],
                    ["shard", "word", "n", "role"],
                )

    return words.select("word", "n").mapInArrow(routes, _ROUTED)


class _Table:
    """Words as rows of code points, to verify many pairs at once."""

    def __init__(self, words: list[str]):
        self.words = words
        codes, self.lengths = _codes(words)
        short = self.lengths <= WIDE
        self.codes = np.full((len(words), WIDE + 2), 0xFFFFFFFF, np.uint32)
        inside = np.arange(WIDE + 2) < np.where(short, self.lengths, 0)[:, None]
        self.codes[inside] = codes[np.repeat(short, self.lengths)]


def _one_apart(one: str, other: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes one word of the other."""
    if len(one) > len(other):
        one, other = other, one
    if len(other) - len(one) > 1 or one == other:
        return False
    same = next((i for i, (a, b) in enumerate(zip(one, other)) if a != b), len(one))
    return one[same + (len(one) == len(other)) :] == other[same + 1 :]


def _verified(left: _Table, i: np.ndarray, right: _Table, j: np.ndarray) -> np.ndarray:
    """Which pairs are one letter apart."""
    near = np.zeros(len(i), bool)
    gap = right.lengths[j] - left.lengths[i]
    wide = (left.lengths[i] > WIDE) | (right.lengths[j] > WIDE)
    for at in np.flatnonzero(wide & (np.abs(gap) <= 1)):
        near[at] = _one_apart(left.words[i[at]], right.words[j[at]])
    level = np.flatnonzero(~wide & (gap == 0))
    near[level] = (left.codes[i[level]] != right.codes[j[level]]).sum(axis=1) == 1
    for step, shorter, a, longer, b in ((1, left, i, right, j), (-1, right, j, left, i)):
        at = np.flatnonzero(~wide & (gap == step))
        x, y = shorter.codes[a[at]], longer.codes[b[at]]
        same = np.logical_and.accumulate(x == y, axis=1).sum(axis=1)
        rest = (x[:, :-1] == y[:, 1:])[:, ::-1]
        rest = np.logical_and.accumulate(rest, axis=1)[:, ::-1]
        near[at] = rest[np.arange(len(at)), same]
    return near


def _alike_halves(
    looked: list[str], q: np.ndarray, held: list[str], low: int, high: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of words with one vector, the pairs that share their first or their second half: one
    letter leaves one half alone. For a leaf that no group of letters divides."""
    index: dict[tuple, list[int]] = {}
    for s in range(low, high):
        word = held[s]
        for size in (len(word) - 1, len(word), len(word) + 1):
            half = size // 2
            index.setdefault((size, 0, word[:half]), []).append(s)
            index.setdefault((size, 1, word[len(word) - (size - half) :]), []).append(s)
    for at in q.tolist():
        word = looked[at]
        half = len(word) // 2
        found = {*index.get((len(word), 0, word[:half]), ())}
        found.update(index.get((len(word), 1, word[half:]), ()))
        yield np.full(len(found), at), np.fromiter(found, np.int64, len(found))


class Trie:
    """Words by their counts in one group after another."""

    def __init__(self, words: list[str], order: list[int]):
        self.order = order
        counts = vectors(words, order)
        rows = np.ascontiguousarray(counts.astype(">u4")).view(f"S{4 * GROUPS}").ravel()
        self.ranked = np.argsort(rows, kind="stable")
        self.words = [words[i] for i in self.ranked.tolist()]
        self.counts = counts[self.ranked]
        self.marks, self.table = _marks(self.counts), _Table(self.words)

    def near(self, looked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a word looked for and a word held that are one letter apart."""
        parts = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(looked), 1 << 15):
            some = looked[at : at + (1 << 15)]
            table, held, size = _Table(some), [], 0
            ends = (np.zeros(0, np.int64),) * 2
            for found in itertools.chain(self._candidates(some), [None]):
                if found is not None:
                    held.append(found)
                    size += len(found[0])
                if size > 1 << 16 or found is None:
                    i, s = map(np.concatenate, zip(*held, ends))
                    kept = _verified(table, i, self.table, s)
                    parts.append(np.stack([i[kept] + at, self.ranked[s[kept]]]))
                    held, size = [], 0
        return tuple(np.concatenate(parts, axis=1))

    def _candidates(self, looked: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The search, depth first; what it reaches comes in bounded parts."""
        wanted = vectors(looked, self.order)
        asked, one = _marks(wanted), np.uint64(1)
        nothing = np.zeros(len(looked), bool)
        stack = [(0, len(self.words), 0, np.arange(len(looked)), nothing, nothing)]
        while stack:
            low, high, depth, q, plus, minus = stack.pop()
            if high - low <= LEAF:
                # A surplus or deficit of one sets one bit that the other word lacks, or none.
                bits = self.marks[low:high]
                for at in range(0, len(q), 1 << 11):
                    part = q[at : at + (1 << 11)]
                    mine = asked[part, None]
                    over, under = bits & ~mine, mine & ~bits
                    fits = ((over & (over - one)) | (under & (under - one))) == 0
                    i, s = np.nonzero(fits)
                    yield part[i], s + low
                continue
            if depth == GROUPS:
                yield from _alike_halves(looked, q, self.words, low, high)
                continue
            column, mine = self.counts[low:high, depth], wanted[q, depth]
            edges = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), high - low]
            for a, b in zip(edges, edges[1:]):
                gap = column[a] - mine
                more, less = gap == 1, gap == -1
                goes = np.flatnonzero((gap == 0) | (more & ~plus) | (less & ~minus))
                if len(goes):
                    child = (q[goes], plus[goes] | more[goes], minus[goes] | less[goes])
                    stack.append((low + a, low + b, depth + 1, *child))


def pairs(words: DataFrame, block: int = 1 << 14) -> DataFrame:
    """Each pair of near words once, with their counts, from distinct words and their ``n``."""
    order = _spread(words)
    count = words.count()
    levels = max(3, math.ceil(math.log(max(count / block, 1)) / math.log(2.5)))
    routed = stored(_routed(words, order, levels), "spelling-routed")

    held, looked = F.col("role") == _STORED, F.col("role") != _STORED
    sizes = routed.groupBy("shard").agg(F.count_if(held).alias("s"), F.count_if(looked).alias("q"))
    # Words looked for are cheaper than words held: only what must be copied is.
    blocks = stored(
        sizes.where("s > 0").select(
            "shard",
            F.ceil(F.col("s") / block).alias("s_blocks"),
            F.ceil(F.col("q") / (8 * block)).alias("q_blocks"),
        ),
        "spelling-blocks",
    )
    dealt = routed.join(blocks, "shard")
    hashed = F.xxhash64("word")
    own_s, own_q = F.pmod(hashed, "s_blocks"), F.pmod(hashed, "q_blocks")
    every_s = F.sequence(F.lit(0), F.col("s_blocks") - 1)
    every_q = F.sequence(F.lit(0), F.col("q_blocks") - 1)
    dealt = dealt.select(
        "shard",
        F.explode(F.when(held, F.array(own_s)).otherwise(every_s)).alias("s_block"),
        F.when(held, every_q).otherwise(F.array(own_q)).alias("q_blocks"),
        "word",
        "n",
        "role",
    ).withColumn("q_block", F.explode("q_blocks"))

    def search(table: pa.Table) -> pa.Table:
        words, n = table["word"].to_pylist(), table["n"].to_numpy()
        role = table["role"].to_numpy()
        s, q = np.flatnonzero(role == _STORED), np.flatnonzero(role != _STORED)
        mine, other = Trie([words[i] for i in s], order).near([words[i] for i in q])
        mine, other = q[mine], s[other]
        # Inside a shard both words look for each other: the first in order has it.
        kept = [
            at
            for at, (i, j) in enumerate(zip(mine.tolist(), other.tolist()))
            if role[i] == _SENT or words[i] < words[j]
        ]
        mine, other = mine[kept], other[kept]
        return pa.table(
            {
                "word": pa.array([words[i] for i in mine], pa.string()),
                "n": pa.array(n[mine], pa.int64()),
                "other": pa.array([words[i] for i in other], pa.string()),
                "other_n": pa.array(n[other], pa.int64()),
            }
        )

    found = dealt.select("shard", "s_block", "q_block", "word", "n", "role")
    return found.groupBy("shard", "s_block", "q_block").applyInArrow(search, _PAIRS)


def _roots(forms: DataFrame) -> DataFrame:
    """The last word that each word's forms lead to. A form has a larger count than its word, so
    there is one; each round follows what the round before found, twice as far."""
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(onward, "root", "left").select(
            "word",
            F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved"),
        )
        moved = stored(moved, "spelling-roots")
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links


def group(words: DataFrame, ratio: int = 10, block: int = 1 << 14) -> DataFrame:
    """A row for each word of (word, n): the number of its near words; its form, the near word of
    largest n if that is ``ratio`` times its own or more, with its n; and its root, the last of the
    forms from there on."""
    words = words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(words, "spelling-words")
    found = stored(pairs(words, block), "spelling-pairs")
    back = found.select(
        F.col("other").alias("word"),
        F.col("other_n").alias("n"),
        F.col("word").alias("other"),
        F.col("n").alias("other_n"),
    )
    near = found.unionAll(back).groupBy("word", "n").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("least"), "other")).alias("best"),
    )
    takes = -F.col("best.least") >= ratio * F.col("n")
    near = stored(
        near.select(
            "word",
            "n_near",
            F.when(takes, F.col("best.other")).alias("form"),
            F.when(takes, -F.col("best.least")).alias("form_n"),
        ),
        "spelling-near",
    )
    roots = _roots(near.where("form IS NOT NULL"))
    return (
        words.join(near, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            "form_n",
        )
    )
