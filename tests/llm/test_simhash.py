import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline as pipeline
from clickloom.llm import simhash, vptree
from clickloom.llm.components import components


def joined(count, pairs):
    """The least member of everyone's group."""
    parent = list(range(count))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(count)]


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    grams = grams or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(gram.encode(), seed=42) for gram in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_pairs(prints, radius):
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                yield i, j


def test_equals_brute_force(spark, documents, texts):
    keys = sorted(texts)
    prints = [brute_print(texts[k]) for k in keys]
    least = joined(len(keys), near_pairs(prints, 3))
    wanted = [(k, f"{p:016x}", keys[r]) for k, p, r in zip(keys, prints, least)]
    assert sorted(map(tuple, simhash.near_copies(documents).collect())) == wanted


def clustered(seed, centers=700):
    rng = random.Random(seed)
    points = [rng.getrandbits(64) for _ in range(centers)]
    for base in points[:150]:
        now = base
        for _ in range(rng.randint(1, 12)):
            for _ in range(rng.randint(1, 4)):
                now ^= 1 << rng.randrange(64)
            points.append(now)
    points = sorted(set(points))
    rng.shuffle(points)
    return points


@pytest.mark.parametrize("leaf", [8, 64])
def test_trees_lose_no_pair(monkeypatch, leaf):
    monkeypatch.setattr(vptree, "LEAF", leaf)
    points = clustered(leaf)
    array = np.array(points, np.uint64)
    names = np.arange(len(points))
    least = joined(len(points), near_pairs(points, 3))
    wanted = {i: r for i, r in enumerate(least) if least.count(r) > 1}
    assert vptree.joined(vptree.links(array[:, None], names, 3)) == wanted
    tree = vptree.plan(array[:400], 4, 3)
    shards, places = vptree.routed(array, tree, 3)
    assert len(set(shards)) > 4
    found = []
    for shard in set(shards):
        held = places[shards == shard]
        found += vptree.links(array[held][:, None], names[held], 3)
    assert vptree.joined(found) == wanted


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 15), unique=True, min_size=1))
def test_points_that_nothing_parts(numbers):
    array = np.array(numbers, np.uint64)[:, None]
    found = vptree.joined(vptree.links(array, np.array(numbers), 4))
    assert found == ({n: min(numbers) for n in numbers} if len(numbers) > 1 else {})


def test_shards_of_a_larger_table_equal_brute_force(spark, monkeypatch):
    points = clustered(9, 5000)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p, p) for p in signed], "point long, p0 long")
    links = simhash.linked(frame, 1, 3, 64, shard_points=500, sample_points=1000)
    found = {r.node: r.root for r in components(links).collect()}
    groups = {}
    for node, root in found.items():
        groups.setdefault(root, set()).add(node)
    array = np.array(points, np.uint64)
    pairs = []
    for start in range(0, len(array), 500):
        near = np.bitwise_count(array[start : start + 500, None] ^ array[None]) <= 3
        pairs += [(int(a) + start, int(b)) for a, b in zip(*np.nonzero(near)) if a + start > b]
    wanted = {}
    for i, root in enumerate(joined(len(points), pairs)):
        wanted.setdefault(root, set()).add(signed[i])
    assert sorted(map(sorted, groups.values())) == sorted(
        sorted(g) for g in wanted.values() if len(g) > 1
    )


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 80)]
    some = [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(70)]
    edges = [*chain, *star, *some, (500, 500), (-5, 7000)]
    rng.shuffle(edges)
    names = sorted({x for e in edges for x in e})
    place = {n: i for i, n in enumerate(names)}
    least = joined(len(names), [(place[a], place[b]) for a, b in edges])
    wanted = {n: names[r] for n, r in zip(names, least) if n != 500}
    lone = {n for n in wanted if list(wanted.values()).count(wanted[n]) == 1}
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {n: r for n, r in wanted.items() if n not in lone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_extra_columns_and_empty_tables(spark, tricky):
    rows = simhash.near_copies(tricky).collect()
    assert len(rows) == tricky.count()
    blank = {r.key: r.component for r in rows if r.fingerprint == "0" * 16}
    assert blank == {None: 1, 1: 1, 2: 1, 4: 1, 9: 1}
    assert [r.component for r in rows if r.key == 3] == [3, 3]
    kept = simhash.one_of_each(tricky)
    assert kept.columns == tricky.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == [1, 3, 5, 6, 8, None]
    assert simhash.near_copies(tricky.limit(0)).count() == 0


def test_several_words_find_copies_that_one_would_lose(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(5000)]
    docs = []
    for number in range(60):
        words = rng.choices(vocabulary, k=250)
        docs.append((2 * number, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(250)] = "changed"
        docs.append((2 * number + 1, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    options = {"shingle": 1, "distinct": True, "words": 6, "radius": 3, "most": 32}
    groups = simhash.near_copies(frame, **options).collect()
    assert all(r.component in (r.key, r.key - 1) for r in groups)
    assert sum(r.component == r.key - 1 for r in groups) >= 57


def test_rows_that_share_a_key_or_have_none_are_of_their_own_groups(spark):
    rng = random.Random(6)

    def prose():
        return " ".join(rng.choices([f"word{i}" for i in range(3000)], k=80))

    a, b, c, d, e, f = (prose() for _ in range(6))
    docs = [(5, a), (5, b), (2, b), (None, c), (None, d), (None, a), (None, c), (7, e), (7, f)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(map(tuple, simhash.one_of_each(frame).collect()), key=str)
    wanted = [(5, a), (2, b), (None, c), (None, d), (7, e), (7, f)]
    assert kept == sorted(wanted, key=str)


def dense(seed, groups, size):
    """Points of six words with one word in common: for each group a base and a few bits changed."""
    rng = random.Random(seed)
    points = set()
    for _ in range(groups):
        base = [rng.getrandbits(64) for _ in range(5)]
        for _ in range(size):
            now = list(base)
            for _ in range(14):
                now[rng.randrange(5)] ^= 1 << rng.randrange(64)
            points.add((7, *now))
    points = sorted(points)
    rng.shuffle(points)
    return np.array(points, np.uint64)


def wanted_groups(points, most):
    label = np.arange(len(points))
    near = np.zeros((len(points), len(points)), bool)
    for i, point in enumerate(points):
        near[i] = np.bitwise_count(points ^ point).sum(1) <= most
    while True:
        lower = np.where(near, label[None, :], len(points)).min(1)
        if (lower == label).all():
            return {i: int(r) for i, r in enumerate(label) if (label == r).sum() > 1}
        label = lower


def test_a_cluster_that_nothing_parts_is_linked_without_holding_its_pairs():
    points = dense(3, 1, 6000)
    names = np.arange(len(points))
    tracemalloc.start()
    found = vptree.joined(vptree.links(points, names, 3, 0, 32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {i: 0 for i in range(len(points))}
    assert peak < 150e6


@pytest.mark.parametrize("most", [16, 20, 28])
def test_a_cluster_of_many_groups_equals_brute_force(most):
    points = dense(most, 90, 26)
    names = np.arange(len(points))
    found = vptree.joined(vptree.links(points, names, 3, 0, most))
    assert found == wanted_groups(points, most)


def test_an_overfull_shard_is_dealt_in_bounded_parts(spark):
    points = dense(5, 40, 20)
    numbers = np.arange(len(points))
    shards, places = np.repeat([4, 5], [len(points), 10]), np.append(numbers, numbers[:10])
    shards, places, parts = simhash.paired(shards, places, numbers, {4: 8})
    sizes = Counter(zip(shards.tolist(), parts.tolist()))
    assert sizes.pop((5, 0)) == 10
    assert len(sizes) == 28 and max(sizes.values()) < 2.6 * len(points) / 8
    met = {}
    for place, part in zip(places[shards == 4].tolist(), parts[shards == 4].tolist()):
        met.setdefault(place, set()).add(part)
    assert all(met[a] & met[b] for a in met for b in met)
    signed = points.view(np.int64).tolist()
    schema = "point long, " + ", ".join(f"p{i} long" for i in range(6))
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(signed)], schema)
    links = simhash.linked(frame, 6, 3, 24, shard_points=100, sample_points=100).collect()
    root = joined(len(points), [(r.a, r.b) for r in links])
    found = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    assert found == wanted_groups(points, 24)


def test_words_in_another_order_are_no_copies(spark):
    """One set of words in five orders, three times each, and one of them with two words changed."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(200)]
    orders = [rng.sample(words, len(words)) for _ in range(5)]
    changed = list(orders[0])
    changed[50] = changed[150] = "other"
    texts = [" ".join(order) for order in orders for _ in range(3)] + [" ".join(changed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = simhash.one_of_each(docs, **pipeline.NEAR)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 6, 9, 12]


def test_sketches_tell_how_alike_texts_are():
    rng = random.Random(9)
    for share in (0.5, 0.7, 0.8, 0.9, 1.0):
        equal = []
        for _ in range(60):
            words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
            other = list(words)
            # Blocks of words changed at one end leave about this share of all shingles alike.
            for i in range(round(400 * (1 - share) / (1 + share))):
                other[i] = f"x{rng.randrange(10**6)}"
            a, b = (simhash.sketch(" ".join(t).encode(), 5, 8) for t in (words, other))
            differ = sum((x >> s) & 15 != (y >> s) & 15 for x, y in zip(a, b) for s in range(0, 64, 4))
            equal.append(128 - differ)
        expected = 128 * (share + (1 - share) / 16)
        assert abs(sum(equal) / len(equal) - expected) < 4
    for odd in (None, b"", b"one", b"a b c d"):
        assert len(simhash.sketch(odd, 5, 8)) == 8
