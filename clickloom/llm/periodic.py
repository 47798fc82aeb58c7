"""Stretches of text that repeat themselves with a period, by seeds on diagonals.

A run is a maximal stretch of words that equal the words one smallest period before them, of at
least ``min_words`` words and ``min_exponent`` periods. Laid over itself one period on, it overlaps
in at least ``max(min_words, min_exponent * period) - period`` words. Periods are taken in classes
whose largest is at most half the least overlap of the class; that overlap is the length k of the
class's grams. The first k-gram of a run then occurs again exactly one period on and, as two
periods of a gram twice as long as either would have a common divisor for a period, nowhere
between. So it is enough to index the k-grams of a document and list each occurrence with the next
one, if their lag is in the class: a number of pairs that grows with the text, whatever repeats in
it. Each pair is a seed, extended both ways along its diagonal while words agree; a table holds, for
each lag, how far its diagonal is covered, and a seed inside that is passed over.

Grams are compared by exact ranks, doubled in length from one word on, among the words of one
document; a position whose gram occurs once leaves all later classes.

Defined cases: a null, empty or blank text has no words, no runs and an empty collapsed text; a null
key stays null; equal rows and equal keys are separate documents; a text of any length is taken
whole, by one task; an empty table gives no row. Columns other than key and text are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = (
    "key long, n_words long, runs array<struct<start: long, length: long, period: long>>,"
    " collapsed string"
)


def classes(longest: int, min_words: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """The least and the greatest period of each class, and the length of its grams, for texts of
    up to so many words. Grams never become shorter from one class to the next."""
    low, turn = 1, min_words // min_exponent + 1
    while max(min_words, min_exponent * low) <= longest:
        high = (min_exponent - 1) * low // 2
        later = range(low, max(high, turn) + 1)
        grams = min(max(min_words, min_exponent * q) - q for q in later)
        yield low, high, grams
        low = high + 1


def _ranked(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with a key that occurs twice or more, by key and place, with a rank for each key, and
    where a place's next one of the same key stands after it."""
    if not len(keys):
        return places, places, np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    again = keys[1:] == keys[:-1]
    edge = np.zeros(1, bool)
    shared = np.concatenate([edge, again]) | np.concatenate([again, edge])
    ranks = np.cumsum(~np.concatenate([edge, again])) - 1
    follows = np.concatenate([again, edge])
    return places[shared], ranks[shared], follows[shared]


class _Grams:
    """Ranks of ever longer grams at the places of an array of words."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        """``owner`` is the number of each word's document: grams of two documents never agree."""
        self.size = 1
        self.rank = np.full(len(words), -1, np.int64)
        places = np.arange(len(words))
        shared, ranks, _ = _ranked(owner * (int(words.max(initial=0)) + 1) + words, places)
        self.rank[shared] = ranks
        self.alive = np.sort(shared)

    def _of(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grams of a size up to twice the present one, of two that overlap."""
        places = self.alive[self.alive <= len(self.rank) - size]
        second = self.rank[places + (size - self.size)]
        places, second = places[second >= 0], second[second >= 0]
        return _ranked(self.rank[places] * len(self.rank) + second, places)

    def seeds(self, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Lags between those bounds and places of all grams with the next one of their kind."""
        while 2 * self.size <= size:
            shared, ranks, _ = self._of(2 * self.size)
            self.rank = np.full(len(self.rank), -1, np.int64)
            self.rank[shared] = ranks
            self.alive, self.size = np.sort(shared), 2 * self.size
        places, _, follows = self._of(size)
        at = np.flatnonzero(follows)
        lags = places[at + 1] - places[at]
        wanted = (lags >= low) & (lags <= high)
        return lags[wanted], places[at][wanted]


def _reach(left: np.ndarray, right: np.ndarray) -> int:
    """How many first elements agree, read in blocks of growing length."""
    done, block, count = 0, 64, min(len(left), len(right))
    while done < count:
        end = min(done + block, count)
        differ = np.flatnonzero(left[done:end] != right[done:end])
        if len(differ):
            return done + int(differ[0])
        done, block = end, 2 * block
    return count


def runs_of(
    words: np.ndarray, owner: np.ndarray, min_words: int = 6, min_exponent: int = 4
) -> list[tuple[int, int, int]]:
    """Start, length and period of every run, by start and period. ``words`` are numbers, those of
    one document together; ``owner`` is the number of each word's document, ascending."""
    longest = int(np.bincount(owner).max(initial=0))
    # A number of its own between documents, so that no diagonal runs on into the next.
    gaps = np.flatnonzero(np.diff(owner)) + 1
    walls = -1 - np.arange(len(gaps) + 1)
    walled = np.concatenate([walls[:1], np.insert(words, gaps, walls[1:]), [-len(gaps) - 2]])
    shift = np.arange(len(words)) + 1 + np.searchsorted(gaps, np.arange(len(words)), "right")
    back = np.zeros(len(walled), np.int64)
    back[shift] = np.arange(len(words))

    grams = _Grams(words, owner)
    found = []
    for low, high, size in classes(longest, min_words, min_exponent):
        if not len(grams.alive):
            break
        lags, places = grams.seeds(size, low, high)
        covered: dict[int, int] = {}
        for at in np.lexsort((places, lags)):
            lag, place = int(lags[at]), int(shift[places[at]])
            if place < covered.get(lag, 0):
                continue
            ahead = _reach(walled[place:], walled[place + lag :])
            behind = _reach(walled[:place][::-1], walled[: place + lag][::-1])
            covered[lag] = place + ahead
            length = behind + ahead + lag
            if length >= max(min_words, min_exponent * lag):
                found.append((int(back[place - behind]), length, lag))
    return sorted(found, key=lambda run: (run[0], run[2]))


def find(
    docs: DataFrame,
    min_words: int = 6,
    min_exponent: int = 4,
    batch_words: int = 1 << 19,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The runs of every text, by start and period, and the text ``collapsed``: its words joined by
    one space, without those that a run holds after its first period."""
    if min_exponent < 3:
        raise ValueError("a run needs three periods or more")

    def searched(texts: pa.Array) -> list[pa.Array]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        every = split.flatten()
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(split)), lengths)
        # White space at either end of a text leaves an empty part there.
        real = pc.greater(pc.binary_length(every), 0)
        values = every.filter(real)
        owner = owner[real.to_numpy(zero_copy_only=False)]
        words = values.dictionary_encode().indices.to_numpy().astype(np.int64)
        runs = runs_of(words, owner, min_words, min_exponent)

        counts = np.bincount(owner, minlength=len(split))
        first = np.concatenate([[0], np.cumsum(counts)])
        kept = np.ones(len(words), bool)
        held = np.zeros(len(split), np.int64)
        for start, length, period in runs:
            kept[start + period : start + length] = False
            held[owner[start]] += 1
        left = np.bincount(owner[kept], minlength=len(split))
        joined = pc.binary_join(
            pa.LargeListArray.from_arrays(
                np.concatenate([[0], np.cumsum(left)]), values.filter(pa.array(kept))
            ),
            pa.scalar(" ", pa.large_string()),
        )
        table = np.array(runs, np.int64).reshape(-1, 3)
        starts = table[:, 0] - first[owner[table[:, 0]]] if len(runs) else table[:, 0]
        structs = pa.StructArray.from_arrays(
            [pa.array(starts), pa.array(table[:, 1]), pa.array(table[:, 2])],
            ["start", "length", "period"],
        )
        offsets = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, structs)
        return [pa.array(counts, pa.int64()), lists, joined.cast(pa.string())]

    def searching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # About seven bytes to a word: documents are taken together up to that bound.
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy() // 7 + 1
            number = np.cumsum(sizes) // batch_words
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low < high:
                    part = batch.slice(low, high - low)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), *searched(part.column(1))],
                        ["key", "n_words", "runs", "collapsed"],
                    )

    named = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")
    )
    return named.mapInArrow(searching, RUNS)
