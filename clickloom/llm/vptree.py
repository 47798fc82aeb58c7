"""Vantage-point trees over 64-bit fingerprints under Hamming distance."""

from __future__ import annotations

import numpy as np

LEAF = 512
#: Points of a dense cluster that are compared with all of it first.
PIVOTS = 64


def distances(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


def split(points: np.ndarray, radius: int, tries: int = 6) -> tuple[int, int] | None:
    """A vantage point and the largest distance of its inner side, or nothing if none parts them.

    Of a few vantage points, the one is taken for which the fewest points lie so close to the
    border that their neighbours may be on the other side.
    """
    best = None
    for place in np.linspace(0, len(points) - 1, tries).astype(int):
        counts = np.bincount(distances(points, points[place]), minlength=65)
        inside = np.cumsum(counts)
        for border in range(64):
            share = inside[border] / len(points)
            if 0.3 <= share <= 0.7:
                outside = len(points) - inside[border]
                doubled = inside[border] - (inside[border - radius] if border >= radius else 0)
                cost = max(inside[border], outside + doubled)
                if cost < 0.95 * len(points) and (best is None or cost < best[0]):
                    best = (cost, int(points[place]), border)
    return best and best[1:]


def sides(points: np.ndarray, vantage: int, border: int, radius: int):
    """Which points are inside, and which the outer side must hold: its own, and those inside that
    by the triangle bound can have a neighbour within the radius there."""
    far = distances(points, vantage)
    return far <= border, far > border - radius


def plan(sample: np.ndarray, depth: int, radius: int):
    """A routing tree: nested (vantage, border, inner, outer), leaves are None."""
    parting = split(sample, radius) if depth and len(sample) > 8 else None
    if parting is None:
        return None
    far = distances(sample, parting[0])
    inner, outer = sample[far <= parting[1]], sample[far > parting[1]]
    return (*parting, plan(inner, depth - 1, radius), plan(outer, depth - 1, radius))


def routed(points: np.ndarray, tree, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards that must hold each point: (shard, place of the point)."""
    shards, held, todo = [], [], [(1, tree, np.arange(len(points)))]
    while todo:
        number, node, here = todo.pop()
        if node is None:
            shards.append(np.full(len(here), number, np.int64))
            held.append(here)
            continue
        inside, outside = sides(points[here], node[0], node[1], radius)
        todo.append((2 * number, node[2], here[inside]))
        todo.append((2 * number + 1, node[3], here[outside]))
    return np.concatenate(shards), np.concatenate(held)


#: The lowest bit of each of a sketch word's sixteen parts.
_PARTS = np.uint64(0x1111111111111111)


def _alike(a: np.ndarray, b: np.ndarray, most: int, sketch: tuple[int, int] | None) -> np.ndarray:
    """Whether rows differ in at most ``most`` bits over the words of the fingerprint and, if the
    words from ``sketch[0]`` on are a sketch, in at most ``sketch[1]`` of its four-bit parts."""
    words = a.shape[1] if sketch is None else sketch[0]
    near = np.bitwise_count(a[:, :words] ^ b[:, :words]).sum(-1, dtype=np.int64) <= most
    if sketch is not None:
        differ = a[:, words:] ^ b[:, words:]
        differ |= differ >> np.uint64(2)
        differ |= differ >> np.uint64(1)
        near &= np.bitwise_count(differ & _PARTS).sum(-1, dtype=np.int64) <= sketch[1]
    return near


def _groups(points: np.ndarray, names: np.ndarray, radius: int, word: int, most: int, sketch=None):
    """Of a few points, those with a neighbour, and for each the least name of its group."""
    first = points[:, word]
    near = np.bitwise_count(first[:, None] ^ first[None, :]) <= radius
    linked = np.flatnonzero(near.sum(1) > 1)
    if not len(linked):
        return names[:0], names[:0]
    near = near[np.ix_(linked, linked)]
    if points.shape[1] > 1:
        a, b = np.nonzero(near)
        near[a, b] = _alike(points[linked[a]], points[linked[b]], most, sketch)
    members = names[linked]
    least = members
    while True:
        lower = np.where(near, least[None, :], np.iinfo(np.int64).max).min(1)
        if (lower == least).all():
            return members, least
        least = lower


def _near(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, word: int, most: int, sketch):
    """Which of the points ``a`` (rows) are near which of ``b`` (columns)."""
    near = np.bitwise_count(points[a, word][:, None] ^ points[b, word][None, :]) <= radius
    if points.shape[1] > 1:
        x, y = np.nonzero(near)
        near[x, y] = _alike(points[a[x]], points[b[y]], most, sketch)
    return near


def _dense(points: np.ndarray, names: np.ndarray, radius: int, word: int, most: int, sketch=None):
    """As ``_groups``, for any number of points that nothing parts.

    Pairs are compared in blocks of LEAF by LEAF; each block is folded into the groups before the
    next, so no pairs are kept. A few pivots are compared with all points first, and blocks that are
    one group already are passed over.
    """
    parent = np.arange(len(points))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def flatten() -> None:
        while (parent != parent[parent]).any():
            parent[:] = parent[parent]

    def fold(a: np.ndarray, b: np.ndarray) -> None:
        near = _near(points, a, b, radius, word, most, sketch)
        if not near.any():
            return
        held = np.concatenate([[root(x) for x in a.tolist()], [root(x) for x in b.tolist()]])
        rows, columns, none = held[: len(a)], held[len(a) :], len(points)
        while True:
            low = np.minimum(rows, np.where(near, columns[None, :], none).min(1))
            lower = np.minimum(columns, np.where(near, low[:, None], none).min(0))
            if (low == rows).all() and (lower == columns).all():
                break
            rows, columns = low, lower
        least = np.concatenate([rows, columns])
        moved = held != least
        for x, y in set(zip(held[moved].tolist(), least[moved].tolist())):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)

    everyone = np.arange(len(points))
    for _ in range(PIVOTS):
        flatten()
        alone = np.flatnonzero(np.bincount(parent, minlength=len(points))[parent] == 1)
        if not len(alone):
            break
        pivot = alone[len(alone) // 2 : len(alone) // 2 + 1]
        for start in range(0, len(points), LEAF * LEAF):
            part = everyone[start : start + LEAF * LEAF]
            near = part[_near(points, pivot, part, radius, word, most, sketch)[0]]
            for x in np.unique(parent[near]).tolist():
                x, y = root(x), root(pivot[0])
                parent[max(x, y)] = min(x, y)
    flatten()
    order = np.argsort(parent, kind="stable")
    starts = np.arange(0, len(points), LEAF)
    for i, start in enumerate(starts):
        flatten()
        now = parent[order]
        low, top = np.minimum.reduceat(now, starts), np.maximum.reduceat(now, starts)
        one = (low == low[i]) & (top == low[i]) & (top[i] == low[i])
        for j in np.flatnonzero(~one[i:]) + i:
            fold(order[start : start + LEAF], order[starts[j] : starts[j] + LEAF])
    flatten()
    linked = np.bincount(parent, minlength=len(points))[parent] > 1
    least = np.full(len(points), np.iinfo(np.int64).max)
    np.minimum.at(least, parent, names)
    return names[linked], least[parent][linked]


def links(
    points: np.ndarray,
    names: np.ndarray,
    radius: int,
    word: int = 0,
    most: int = 64,
    sketch: tuple[int, int] | None = None,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect exactly what near pairs connect: (names, least names).

    Points have a row each and a column for every word of the fingerprint. A pair is near if one
    ``word`` differs in at most ``radius`` bits, and all words together in at most ``most``; the
    columns from ``sketch[0]`` on may be a sketch, of whose parts at most ``sketch[1]`` differ.
    """
    found, todo = [], [np.arange(len(points))]
    while todo:
        here = todo.pop()
        parting = split(points[here, word], radius) if len(here) > LEAF else None
        if parting is not None:
            inside, outside = sides(points[here, word], *parting, radius)
            todo += [here[inside], here[outside]]
        elif len(here) <= 4 * LEAF:
            found.append(_groups(points[here], names[here], radius, word, most, sketch))
        else:  # nothing parts them
            found.append(_dense(points[here], names[here], radius, word, most, sketch))
    return found


def joined(found: list[tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """The least member of the group of every linked point."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for members, leasts in found:
        for a, b in zip(members.tolist(), leasts.tolist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}
