"""Logistic context mixing: the probability of a word, bit by bit, from hashed contexts.

A word's bytes and a space after it are coded bit by bit. Six predictors look at a growing context
inside the word: nothing, the last one to four bytes, and the whole beginning of the word. Each holds
how often a 0 and a 1 came next, in a table addressed by a hash of context and bits so far. Their
log-odds are mixed by two sets of weights, one gated by how much the long contexts have seen, one
by the place in byte and word; a last stage refines the mix by what came true of like predictions
after the same byte. Words run side by side in numpy, a bit at a time. What is coded of a word, its
bytes and the space, is cut into pieces of ``PIECE`` bytes that each start anew, so that a very long
word is many short lanes instead of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

ORDERS = 6
#: Slots of each predictor's table, as powers of two.
BITS = (8, 16, 18, 20, 21, 22)
GATES, PLACES, BUCKETS = 24, 32, 33
MOST = 65535
_LOG = np.log(np.arange(MOST + 1) + 0.4).astype(np.float32)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: What tells the hashed contexts of one predictor from another's.
_SALT = [np.uint64(i * 0xC2B2AE3D27D4EB4F & (2**64 - 1)) for i in range(ORDERS)]


#: Bytes that are coded in one go, and beginnings that are looked at together.
PIECE, LANES = 64, 1 << 14


def coded(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """What is coded, in pieces, and the number of the word of each piece."""
    pieces, owner = [], []
    for number, word in enumerate(words):
        word += b" "
        for at in range(0, len(word), PIECE):
            pieces.append(word[at : at + PIECE])
            owner.append(number)
    return pieces, np.array(owner, np.int64)


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pieces and their lengths."""
    size = np.array([len(w) for w in words])
    width = int(size.max())
    raw = b"".join(w.ljust(width, b" ") for w in words)
    return np.frombuffer(raw, np.uint8).reshape(len(words), width), size


def _contexts(last: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
    masks = [np.uint64((1 << 8 * n) - 1) for n in range(1, 5)]
    return [np.zeros(len(last), np.uint64), *(last & mask for mask in masks), whole]


def _bits(contexts: list[np.ndarray], byte: np.ndarray) -> Iterator[tuple]:
    """The bits of a byte from the highest on: which, what came, the slots of every predictor."""
    hashed = [c * _K[0] + salt for c, salt in zip(contexts, _SALT)]
    hashed = [h ^ (h >> np.uint64(29)) for h in hashed]
    node = np.ones(len(byte), np.uint64)
    for bit in range(7, -1, -1):
        slots = [node, (contexts[1] << np.uint64(8)) | node]
        for order in range(2, ORDERS):
            mixed = hashed[order] ^ node
            mixed *= _K[1]
            mixed ^= mixed >> np.uint64(32)
            mixed *= _K[2]
            mixed >>= np.uint64(64 - BITS[order])
            slots.append(mixed)
        came = (byte >> np.uint64(bit)) & np.uint64(1)
        yield bit, came.astype(np.uint8), slots
        node = (node << np.uint64(1)) | came


class Beginnings:
    """Steps through the bytes of pieces, where pieces that begin alike are one as far as they do."""

    def __init__(self, pieces: list[bytes]):
        held, size = matrix(pieces)
        width = max(held.shape[1], 16)
        wide = np.full((len(pieces), width), 0x20, np.uint8)
        wide[:, : held.shape[1]] = held
        # Alike ones beside each other, as far as their first bytes tell.
        first, second = (np.ascontiguousarray(wide[:, at : at + 8]).view(">u8").ravel() for at in (0, 8))
        self.order = np.lexsort((second.astype(np.uint64), first.astype(np.uint64)))
        self.bytes, self.size = wide[self.order], size[self.order]
        other = self.bytes[1:] != self.bytes[:-1]
        alike = np.where(other.any(1), other.argmax(1), width)
        #: How many bytes a piece has in common with the one before.
        self.alike = np.concatenate([[0], np.minimum(alike, self.size[1:])])

    def __iter__(self) -> Iterator[tuple]:
        """Place, which pieces run, the number of each one's beginning, the first piece of each
        beginning, its number a place before, the contexts and the byte."""
        running = np.arange(len(self.size))
        number = np.zeros(len(self.size), np.int64)
        last, whole = np.full(1, 0x20, np.uint64), np.full(1, _K[2], np.uint64)
        for place in range(int(self.size.max())):
            running = running[self.size[running] > place]
            fresh = self.alike[running] <= place
            fresh[0] = True
            leads = running[fresh]
            above = number[leads]
            number[running] = np.cumsum(fresh) - 1
            byte = self.bytes[leads, place].astype(np.uint64)
            last, whole = last[above], whole[above]
            yield place, running, number[running], np.flatnonzero(fresh), above, last, whole, byte
            last = (last << np.uint64(8)) | byte
            whole = (whole ^ byte) * _K[1] + _K[0]


def empty() -> list[np.ndarray]:
    """Tables without counts; the small ones, whose counts grow largest, are the more exact."""
    return [np.zeros((1 << b, 2), np.float64 if b <= 16 else np.float32) for b in BITS]


def counted(words: list[bytes], counts: np.ndarray, long: np.ndarray) -> list[np.ndarray]:
    """Sums of counts by predictor, slot and bit; only words marked ``long`` enter the last one."""
    tables = empty()
    add(tables, words, counts, long)
    return tables


def add(tables: list[np.ndarray], words: list[bytes], counts: np.ndarray, long: np.ndarray) -> None:
    """Put words into tables."""
    if not words:
        return
    pieces, owner = coded(words)
    begun = Beginnings(pieces)
    whose = owner[begun.order]
    weight = counts[whose]
    deep = weight * long[whose]
    for _, running, _, leads, _, last, whole, byte in begun:
        sums = [np.add.reduceat(part[running], leads) for part in (weight, deep)]
        for at in range(0, len(byte), LANES):
            part = slice(at, at + LANES)
            for _, came, slots in _bits(_contexts(last[part], whole[part]), byte[part]):
                for order in range(ORDERS):
                    held = sums[order == ORDERS - 1][part]
                    cells = (slots[order] * np.uint64(2) + came).astype(np.int64)
                    np.add.at(tables[order].reshape(-1), cells, held.astype(tables[order].dtype))


def squeezed(table: np.ndarray) -> np.ndarray:
    """Counts in 16 bits; pairs that are too large keep their ratio."""
    scale = np.maximum(1.0, table.max(-1, keepdims=True) / MOST)
    return np.where(table > 0, np.maximum(1, table / scale), 0).astype(np.uint16)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Mixer:
    """Weights by gate and by place, and the refining table."""

    by_gate: np.ndarray
    by_place: np.ndarray
    refine: np.ndarray

    @staticmethod
    def fresh() -> "Mixer":
        share = np.full(ORDERS + 1, 0.3, np.float32)
        share[-1] = 0.0
        centers = squash(np.linspace(-8, 8, BUCKETS))
        # The table starts as no change, with the weight of a few observations.
        refine = np.stack([1 - centers, centers], -1) * 20.0
        return Mixer(
            np.tile(share, (GATES, 1)),
            np.tile(share, (PLACES, 1)),
            np.tile(refine, (256, 1, 1)),
        )


def whole_bucket(seen: np.ndarray) -> np.ndarray:
    return np.searchsorted([1, 3, 9, 65, 1025], seen, "right").astype(np.uint8)


def four_bucket(seen: np.ndarray) -> np.ndarray:
    return np.searchsorted([1, 4, 16], seen, "right").astype(np.uint8)


def _refined(refine: np.ndarray, odds: np.ndarray, last: np.ndarray):
    """Probability of a 1 after refining, with the rows and shares of the refining table."""
    at = np.clip((odds + 8) * ((BUCKETS - 1) / 16), 0, BUCKETS - 1.001)
    low = at.astype(np.int64)
    share = at - low
    context = last.astype(np.int64)
    left, right = refine[context, low], refine[context, low + 1]
    chance = (1 - share) * left[:, 1] / (left[:, 0] + left[:, 1])
    chance += share * right[:, 1] / (right[:, 0] + right[:, 1])
    return np.clip(0.5 * squash(odds) + 0.5 * chance, 1e-6, 1 - 1e-6), low, share, context


def learned(
    tables: list[np.ndarray],
    words: list[bytes],
    counts: np.ndarray,
    draws: int | None,
    seed: int,
    rate: float = 0.05,
) -> Mixer:
    """Weights and refining table learned online, over all words as often as they come or, with
    ``draws``, over so many drawn by that.

    Each is priced before it is learned from, and without what it put into the tables itself.
    """
    mixer, rng = Mixer.fresh(), np.random.default_rng(seed)
    times = np.asarray(counts, float)
    if draws is not None:
        times = np.bincount(rng.choice(len(words), draws, p=times / times.sum()), minlength=len(words))
    taken = rng.permutation(np.flatnonzero(times))
    together = min(max(2048, len(taken) // 16), 2 * LANES)
    steps = -(-len(taken) // together)
    for step in range(steps):
        part = taken[step * together : (step + 1) * together]
        pieces, owner = coded([words[i] for i in part.tolist()])
        begun = Beginnings(pieces)
        often = times[part][owner][begun.order]
        now = rate * (1 - 0.9 * step / steps)
        for place, running, _, leads, _, last, whole, byte in begun:
            sums = np.add.reduceat(often[running], leads)
            for at in range(0, len(byte), LANES):
                lanes = slice(at, at + LANES)
                _learn(mixer, tables, min(place, 3) * 8, last[lanes], whole[lanes], byte[lanes], sums[lanes], now)
    return mixer


def _learn(
    mixer: Mixer,
    tables: list[np.ndarray],
    spot: int,
    last: np.ndarray,
    whole: np.ndarray,
    byte: np.ndarray,
    times: np.ndarray,
    now: float,
) -> None:
    """Learn from bytes after their contexts, each so many times."""
    contexts = _contexts(last, whole)
    before = contexts[1].astype(np.int64)
    rows = np.arange(len(byte))
    inputs = np.empty((len(byte), ORDERS + 1), np.float32)
    inputs[:, ORDERS] = 0.3
    for bit, came, slots in _bits(contexts, byte):
        for order in range(ORDERS):
            held = tables[order].take(slots[order].view(np.int64), 0, mode="clip")
            own = held[rows, came]
            held[rows, came] = own - (own > 0)
            inputs[:, order] = _LOG.take(held[:, 1]) - _LOG.take(held[:, 0])
            if order >= 4:
                seen = held[:, 0].astype(np.int64) + held[:, 1]
                gate = four_bucket(seen) if order == 4 else gate + whole_bucket(seen) * 4
        one = np.clip(np.einsum("ij,ij->i", inputs, mixer.by_gate[gate]), -12, 12)
        two = np.clip(inputs @ mixer.by_place[spot + bit], -12, 12)
        miss = (came - squash(one)) * times
        total = np.maximum(np.bincount(gate, times, GATES), 64)
        for i in range(ORDERS + 1):
            mixer.by_gate[:, i] += now * np.bincount(gate, miss * inputs[:, i], GATES) / total
        miss = (came - squash(two)) * times
        mixer.by_place[spot + bit] += now * (miss @ inputs) / max(times.sum(), 64)
        _, low, share, context = _refined(mixer.refine, 0.5 * (one + two), before)
        cells = (context * BUCKETS + low) * 2 + came
        size = mixer.refine.size
        more = np.bincount(cells, (1 - share) * 0.5 * times, size)
        mixer.refine += (more + np.bincount(cells + 2, share * 0.5 * times, size)).reshape(mixer.refine.shape)


def averaged(mixers: list[Mixer]) -> Mixer:
    """The mean weights of learners side by side, and what all of them saw come true."""
    fresh = Mixer.fresh()
    if not mixers:
        return fresh
    return Mixer(
        np.mean([m.by_gate for m in mixers], 0).astype(np.float32),
        np.mean([m.by_place for m in mixers], 0).astype(np.float32),
        fresh.refine + sum(m.refine - fresh.refine for m in mixers),
    )


@dataclass
class Prices:
    """A finished model: log-odds by slot, how much the long contexts saw, and the mixer."""

    odds: list[np.ndarray]
    four: np.ndarray
    whole: np.ndarray
    mixer: Mixer

    @staticmethod
    def of(tables: list[np.ndarray], mixer: Mixer) -> "Prices":
        odds = [(_LOG[t[:, 1]] - _LOG[t[:, 0]]).astype(np.float16) for t in tables]
        four = four_bucket(tables[4].sum(1, dtype=np.int64))
        return Prices(odds, four, whole_bucket(tables[5].sum(1, dtype=np.int64)) * 4, mixer)

    def price(self, words: list[bytes]) -> np.ndarray:
        """log2 of the probability of each word."""
        if not words:
            return np.zeros(0)
        pieces, owner = coded(words)
        begun = Beginnings(pieces)
        found = np.zeros(len(pieces))
        sums = np.zeros(1)
        for place, running, number, _, above, last, whole, byte in begun:
            sums = sums[above]
            for at in range(0, len(byte), LANES):
                part = slice(at, at + LANES)
                sums[part] += self._byte(min(place, 3) * 8, last[part], whole[part], byte[part])
            ends = begun.size[running] == place + 1
            found[begun.order[running[ends]]] = sums[number[ends]]
        return np.bincount(owner, found, len(words))

    def _byte(self, spot: int, last: np.ndarray, whole: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """log2 of the probability of bytes after their contexts."""
        contexts = _contexts(last, whole)
        before = contexts[1].astype(np.int64)
        held = np.empty((len(byte), ORDERS + 1), np.float32)
        held[:, ORDERS] = 0.3
        total = np.ones(len(byte))
        for bit, came, slots in _bits(contexts, byte):
            slots = [s.view(np.int64) for s in slots]
            for order in range(ORDERS):
                held[:, order] = self.odds[order].take(slots[order], mode="clip")
            gate = self.whole.take(slots[5], mode="clip") + self.four.take(slots[4], mode="clip")
            one = np.einsum("ij,ij->i", held, self.mixer.by_gate.take(gate, 0, mode="clip"))
            two = held @ self.mixer.by_place[spot + bit]
            odds = 0.5 * (np.clip(one, -12, 12) + np.clip(two, -12, 12))
            chance, *_ = _refined(self.mixer.refine, odds, before)
            # Eight factors of at least a millionth each.
            total *= np.where(came == 1, chance, 1 - chance)
        return np.log2(total)
