"""Logistic mixing over the words of a text in their order.

The most frequent words and one escape are the leaves of a Huffman tree, and each word of a text is coded
by the yes-or-no decisions on its way. Three predictors look at a decision: how often words below either
branch come in the class of document that the words before speak for, what came after the same word
before, and what came after the same two words before. The last two are counted in tables addressed
by a hash of context and node; their log-odds are mixed by weights gated by how much both have seen. The weights
are those under which the decisions of all texts are likeliest: these are counted by kind, of which there is a fixed
number, so that tasks' counts add up and the fit is small. Every
decision has two chances that add up to one, so the leaves of a context do, whatever collides in
the tables. A word behind the escape is spelled by :mod:`clickloom.llm.mixing`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from clickloom.llm.mixing import MOST

#: Slots of either table, as a power of two.
BITS = 22
#: Words that walk down the tree side by side.
WALK = 1 << 16
#: Decisions of a word whose odds are multiplied before their logarithm is taken.
_TOGETHER = 32
GATES = 16
#: Kinds of what a slot has seen, of a class's log-odds, and of both slots, these and what came.
SEEN, ODDS = 128, 64
CELLS = ODDS * SEEN * SEEN * 2
_LOG = np.log(np.arange(MOST + 1) + 0.4).astype(np.float32)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: The word before the first.
_START = np.int64(-1)


@dataclass
class Tree:
    """The ways from the root: a leaf's decisions are those from ``first`` on, ``depth`` of them."""

    first: np.ndarray
    depth: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> "Tree":
        leaves = len(counts)
        above = np.full(2 * leaves, -1, np.int64)
        side = np.zeros(2 * leaves, np.uint8)
        heap = [(float(n), i) for i, n in enumerate(counts)]
        heapq.heapify(heap)
        for node in range(leaves, 2 * leaves - 1):
            (low, a), (high, b) = heapq.heappop(heap), heapq.heappop(heap)
            above[a] = above[b] = node
            side[b] = 1
            heapq.heappush(heap, (low + high, node))
        at, whose = np.arange(leaves), np.arange(leaves)
        found: list[tuple] = []
        while True:
            going = above[at] >= 0
            at, whose = at[going], whose[going]
            if not len(at):
                break
            found.append((whose, above[at] - leaves, side[at]))
            at = above[at]
        # From the root on.
        leaf, nodes, bits = (
            np.concatenate([part[i] for part in reversed(found)]) if found else np.zeros(0, np.int64)
            for i in range(3)
        )
        order = np.argsort(leaf, kind="stable")
        depth = np.bincount(leaf, minlength=leaves)
        return Tree(
            np.cumsum(depth) - depth, depth, nodes[order].astype(np.int32), bits[order].astype(np.uint8)
        )

    @cached_property
    def rank(self) -> np.ndarray:
        """The place of each leaf from left to right, where leaves below a node are beside each other."""
        keys = [way.astype(np.int64) for way in reversed(self.levels)]
        found = np.empty(len(self.depth), np.int64)
        found[np.lexsort(keys) if keys else np.arange(len(found))] = np.arange(len(found))
        return found

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """For each depth, twice the node of every leaf's decision there, plus its bit."""
        leaf = np.repeat(np.arange(len(self.depth)), self.depth)
        level = np.arange(len(leaf)) - np.repeat(self.first, self.depth)
        table = np.zeros((int(self.depth.max(initial=0)), len(self.depth)), np.int32)
        table[level, leaf] = self.nodes * 2 + self.bits
        return list(table)

    def odds(self, masses: np.ndarray) -> np.ndarray:
        """Log-odds of each node's second branch, for every column of the leaves' masses."""
        leaf = np.repeat(np.arange(len(self.depth)), self.depth)
        cells = self.nodes.astype(np.int64) * 2 + self.bits
        size = 2 * max(len(self.depth) - 1, 1)
        sums = np.stack([np.bincount(cells, mass[leaf], size) for mass in masses.T], 1)
        sums = np.maximum(sums.reshape(-1, 2, masses.shape[1]), 1e-9)
        return np.log(sums[:, 1] / sums[:, 0]).astype(np.float32)


def contexts(words: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
    """Hashes of the word before each word and of the two before; ``firsts`` begin a text."""
    one = np.concatenate([[_START], words[:-1]])
    one[firsts] = _START
    two = np.concatenate([[_START], one[:-1]])
    two[firsts] = _START
    single = (one.astype(np.uint64) + _K[2]) * _K[0]
    double = (single ^ (single >> np.uint64(31)) ^ (two.astype(np.uint64) * _K[1])) * _K[0] + _K[1]
    return [single ^ (single >> np.uint64(29)), double ^ (double >> np.uint64(29))]


def walked(tree: Tree, leaves: np.ndarray, hashed: list[np.ndarray]):
    """Slices of words: the slice, the order of its words by depth, deepest first, and a walk down
    from the root: how many words decide there, their nodes, what came, both slots."""
    for at in range(0, len(leaves), WALK):
        depth = tree.depth[leaves[at : at + WALK]]
        # Numbers of 16 bits are put in order by their digits.
        order = np.argsort((-depth).astype(np.int16), kind="stable")
        yield slice(at, at + WALK), order, _down(
            tree, leaves[at : at + WALK][order], [h[at : at + WALK][order] for h in hashed], depth
        )


def _down(tree: Tree, leaves: np.ndarray, hashed: list[np.ndarray], depth: np.ndarray) -> Iterator[tuple]:
    for level, still in enumerate((len(depth) - np.cumsum(np.bincount(depth))).tolist()):
        if not still:
            return
        way = tree.levels[level].take(leaves[:still])
        node = way >> 1
        spread = node.astype(np.uint64)
        spread *= _K[1]
        slots = []
        for h in hashed:
            slot = h[:still] ^ spread
            slot *= _K[2]
            slot >>= np.uint64(64 - BITS)
            slots.append(slot.view(np.int64))
        yield still, node, way & 1, slots


def empty() -> list[np.ndarray]:
    """Counts of a task, by slot and branch."""
    return [np.zeros(2 << BITS, np.uint32) for _ in range(2)]


def add(tables: list[np.ndarray], tree: Tree, leaves: np.ndarray, hashed: list[np.ndarray]) -> None:
    """Count the decisions of texts."""
    one = np.uint32(1)
    for _, _, down in walked(tree, leaves, hashed):
        for _, _, came, slots in down:
            for table, slot in zip(tables, slots):
                slot <<= 1
                slot += came
                np.add.at(table, slot, one)


def _bucket(seen: np.ndarray) -> np.ndarray:
    return np.searchsorted([1, 4, 32], seen, "right")


def _start() -> np.ndarray:
    return np.tile(np.array([1.0, 0.1, 0.1, 0.0], np.float32), (GATES, 1))


def _kinds(none: np.ndarray, one: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Kinds of slots by what they saw of both branches: up to three as they are, more by their log-odds."""
    seen = none + one
    few = seen * (seen + 1) // 2 + one
    some = 10 + np.clip((odds + 4.4) * (28 / 8.8), 0, 27).astype(np.int64)
    many = 38 + np.clip((odds + 12) * (90 / 24), 0, 89).astype(np.int64)
    return np.where(seen < 4, few, np.where(seen < 32, some, many)).astype(np.uint8)


#: Kinds of what was seen rarely.
_FEW = _kinds(*np.indices((512, 512)), _LOG[np.arange(512)] - _LOG[np.arange(512)][:, None])

#: The bucket of each kind.
_BUCKET_OF = np.repeat([0, 1, 2, 3], [1, 9, 28, 90])


@dataclass
class Lessons:
    """What weights are learned from: the kind of each slot without the word that comes there itself, by slot and
    branch, that of the log-odds of each node and class, and the log-odds a kind stands for."""

    tables: list[np.ndarray]
    slots: list[np.ndarray]
    odds: np.ndarray
    values: list[np.ndarray]

    @staticmethod
    def of(tables: list[np.ndarray], odds: np.ndarray) -> "Lessons":
        held = np.clip(odds.astype(float), -12, 12).reshape(-1)
        kinds = np.clip((held + 12) * (ODDS / 24), 0, ODDS - 1).astype(np.uint8)
        times = np.maximum(np.bincount(kinds, minlength=ODDS), 1)
        slots, values = [], [np.bincount(kinds, held, ODDS) / times]
        for table in tables:
            found = np.empty((len(table), 2), np.uint8)
            sums, times = np.zeros(SEEN), np.zeros(SEEN)
            for at in range(0, len(table), WALK):
                part = table[at : at + WALK].astype(np.int64)
                for came in (0, 1):
                    left = [np.maximum(part[:, branch] - (branch == came), 0) for branch in (0, 1)]
                    logs = _LOG[left[1]] - _LOG[left[0]]
                    found[at : at + WALK, came] = kind = _kinds(*left, logs)
                    sums += np.bincount(kind, logs, SEEN)
                    times += np.bincount(kind, minlength=SEEN)
            slots.append(found.reshape(-1))
            values.append(sums / np.maximum(times, 1))
        return Lessons(tables, slots, kinds, values)

    def without(self, number: int, slot: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Kinds of one table's slots without so many of either branch."""
        left = np.maximum(self.tables[number].take(slot, 0) - own, 0)
        few = (left < len(_FEW)).all(1)
        if few.all():
            return _FEW[left[:, 0], left[:, 1]]
        found = np.empty(len(left), np.uint8)
        found[few] = _FEW[left[few, 0], left[few, 1]]
        many = left[~few]
        found[~few] = _kinds(many[:, 0], many[:, 1], _LOG[many[:, 1]] - _LOG[many[:, 0]])
        return found


def _again(
    text: np.ndarray, hashed: np.ndarray, rank: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Words whose context comes more than once in their text, by text, context and way down the tree, and whether
    each is of another text or context than the one before."""
    mixed = (text.astype(np.uint64) * _K[1]) ^ hashed
    order = np.argsort(mixed)
    same = np.diff(mixed[order]) == 0
    held = np.zeros(len(order), bool)
    held[1:] = same
    held[:-1] |= same
    order = order[held]
    order = order[np.lexsort((rank[order], mixed[order]))]
    return order, np.diff(mixed[order], prepend=~mixed[order[:1]]) != 0


def _own(node: np.ndarray, came: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """How often either branch of a node comes in a text's context, where equals are beside each other."""
    fresh = fresh | (np.diff(node, prepend=-1) != 0)
    begins = np.flatnonzero(fresh)
    size, some = np.diff(begins, append=len(node)), np.add.reduceat(came.astype(np.int64), begins)
    return np.repeat(np.stack([size - some, some], 1), size, 0)


def lessons(
    held: Lessons,
    tree: Tree,
    leaves: np.ndarray,
    hashed: list[np.ndarray],
    kinds: np.ndarray,
    text: np.ndarray,
) -> np.ndarray:
    """How often the decisions of numbered texts are of each kind, with what came."""
    classes = len(held.odds) // max(len(tree.depth) - 1, 1)
    counts = np.zeros(CELLS, np.int64)
    for part, order, down in walked(tree, leaves, hashed):
        kind, cells = kinds[part][order].astype(np.int32), [np.zeros(0, np.int32)]
        whose = text[part][order].astype(np.int64)
        again = [_again(whose, h[part][order], tree.rank[leaves[part][order]]) for h in hashed]
        for still, node, came, slots in down:
            cell = held.odds.take(node * classes + kind[:still], mode="clip").astype(np.int32)
            for number, slot in enumerate(slots):
                seen = held.slots[number].take(slot * 2 + came, mode="clip")
                at, first = again[number]
                going = at < still
                if going.any():
                    # A text or context is another one if any word between was its first.
                    marks = np.cumsum(first)[going]
                    at = at[going]
                    own = _own(node[at], came[at], np.diff(marks, prepend=0) != 0)
                    seen[at] = held.without(number, slot[at], own)
                cell *= SEEN
                cell += seen
            cell *= 2
            cell += came
            cells.append(cell)
        counts += np.bincount(np.concatenate(cells), minlength=CELLS)
    return counts


def fitted(counts: np.ndarray, values: list[np.ndarray], prior: float = 4.0) -> np.ndarray:
    """The weights of each gate under which what came is likeliest, by Newton's steps; a prior of some
    observations holds those of gates that saw little."""
    weights = _start().astype(float)
    begin = weights.copy()
    came = counts.reshape(-1, 2)
    held = np.flatnonzero(came.any(1))
    rest, two = np.divmod(held, SEEN)
    odds, one = np.divmod(rest, SEEN)
    gates = _BUCKET_OF[one] * 4 + _BUCKET_OF[two]
    inputs = np.stack([values[0][odds], values[1][one], values[2][two], np.full(len(held), 0.3)], 1)
    for gate in np.unique(gates).tolist():
        own = gates == gate
        x, none, some = inputs[own], *came[held[own]].astype(float).T

        def cost(w: np.ndarray) -> float:
            mixed = x @ w
            loss = some @ np.logaddexp(0, -mixed) + none @ np.logaddexp(0, mixed)
            return loss + prior / 2 * ((w - begin[gate]) ** 2).sum()

        best = cost(weights[gate])
        for _ in range(50):
            chance = 1 / (1 + np.exp(-np.clip(x @ weights[gate], -30, 30)))
            slope = x.T @ (some - (some + none) * chance) - prior * (weights[gate] - begin[gate])
            bend = (x.T * ((some + none) * chance * (1 - chance))) @ x + prior * np.eye(4)
            step = np.linalg.solve(bend, slope)
            while (now := cost(weights[gate] + step)) > best and np.abs(step).max() > 1e-9:
                step /= 2
            if now >= best:
                break
            weights[gate] += step
            best = now
            if np.abs(step).max() < 1e-7:
                break
    return weights.astype(np.float32)


def learned(tables: list[np.ndarray], tree: Tree, odds: np.ndarray, texts: list[tuple]) -> np.ndarray:
    """Weights learned from texts (leaves, hashes, classes), each without all that it put into the tables."""
    if not texts:
        return _start()
    held = Lessons.of(tables, odds)
    alone = [lessons(held, tree, *text, np.zeros(len(text[0]), np.int64)) for text in texts]
    return fitted(sum(alone), held.values)


@dataclass
class Model:
    """A finished model: log-odds and what was seen of them in one number for each slot."""

    tree: Tree
    odds: np.ndarray
    slots: list[np.ndarray]
    weights: np.ndarray

    @staticmethod
    def of(tree: Tree, odds: np.ndarray, tables: list[np.ndarray], weights: np.ndarray) -> "Model":
        packed = []
        for table in tables:
            value = np.rint((_LOG[table[:, 1]] - _LOG[table[:, 0]]) * 512).astype(np.int32)
            packed.append((value * 4 + _bucket(table.sum(1, dtype=np.int64))).astype(np.int16))
        return Model(tree, odds, packed, weights)

    def price(self, leaves: np.ndarray, hashed: list[np.ndarray], kinds: np.ndarray) -> np.ndarray:
        """log2 of the probability of every word's leaf, given the words before it."""
        found = np.zeros(len(leaves))
        odds = np.ascontiguousarray(self.odds).reshape(-1)
        classes = self.odds.shape[1]
        weights = self.weights.astype(np.float32) * np.float32([1, 1 / 512, 1 / 512, 0.3])
        fixed, first, second, bias = np.ascontiguousarray(weights.T)
        for part, order, down in walked(self.tree, leaves, hashed):
            kind = kinds[part][order].astype(np.int32)
            # Odds against what came, multiplied down the way.
            against = np.ones(len(order))
            sums = np.zeros(len(order))
            for level, (still, node, came, slots) in enumerate(down):
                one, two = (table.take(slot, mode="clip") for table, slot in zip(self.slots, slots))
                gate = ((one & 3) * 4 + (two & 3)).astype(np.int64)
                mixed = odds.take(node * classes + kind[:still], mode="clip")
                mixed *= fixed.take(gate, mode="clip")
                mixed += bias.take(gate, mode="clip")
                mixed += (one >> 2) * first.take(gate, mode="clip")
                mixed += (two >> 2) * second.take(gate, mode="clip")
                np.clip(mixed, -12, 12, out=mixed)
                mixed *= (1 - 2 * came).astype(np.float32)
                against[:still] *= 1.0 + np.exp(mixed).astype(np.float64)
                if level % _TOGETHER == _TOGETHER - 1:
                    sums -= np.log2(against)
                    against.fill(1.0)
            found[part][order] = sums - np.log2(against)
        return found
