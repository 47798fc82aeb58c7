import random
import re
from collections import Counter

import numpy as np
import pytest

from clickloom.llm.cuckoo import CuckooFilter, built
from clickloom.llm.line_dedup import LineIndex, count_lines

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def brute(texts, threshold, counted=None):
    counts = Counter(
        key for t in (texts if counted is None else counted) for key in {key_of(x) for x in (t or "").split("\n")}
    )
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key_of(x) or counts[key_of(x)] < threshold]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def made(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def stripped(index, docs, **options):
    rows = index.strip(docs, **options).select("text", "n_lines", "n_dropped").collect()
    return sorted(tuple(r) for r in rows)


def random_texts(seed, count=120):
    rng = random.Random(seed)
    pool = ["Common line", " common LINE\t", "other", "", " \t", "Ärger", "ärger", "x" * 5000]
    pool += [f"line {i}" for i in range(30)]
    return [
        rng.choice([None, "", "\n".join(rng.choices(pool, k=rng.randint(0, 9)))])
        for _ in range(count)
    ]


@pytest.mark.parametrize("bytes_allowed", [64 << 20, -1])
def test_equals_brute_force_by_filter_and_by_join(spark, bytes_allowed):
    texts = random_texts(1)
    docs = made(spark, texts)
    index = LineIndex.build(docs, threshold=10)
    assert stripped(index, docs, broadcast_bytes=bytes_allowed) == brute(texts, 10)


def test_insertions_and_deletions_equal_a_new_index(spark):
    first, more = random_texts(2), random_texts(3, 300)
    docs, added = made(spark, first), made(spark, more)
    index = LineIndex.build(docs, threshold=10)
    grown = index.insert(added)
    both = docs.union(added)
    assert stripped(grown, both) == brute(first + more, 10)
    back = grown.delete(added)
    assert stripped(back, docs) == brute(first, 10)
    fresh = LineIndex.build(docs, threshold=10)
    assert sorted(map(tuple, back.counts.select("key", "n_docs").collect())) == sorted(
        map(tuple, fresh.counts.select("key", "n_docs").collect())
    )


def test_many_keys_cross_the_threshold_at_once(spark):
    few = ["\n".join(f"line {i}" for i in range(400))] * 2
    docs = made(spark, few)
    index = LineIndex.build(docs, threshold=4)
    grown = index.insert(docs)
    assert stripped(grown, docs) == [("", 400, 400)] * 2
    assert stripped(grown.delete(docs), docs) == sorted([(few[0], 400, 0)] * 2)


def test_least_length_of_keys(spark):
    docs = made(spark, ["ab\nabc\nÄÖ"] * 3)
    index = LineIndex.build(docs, threshold=2, min_chars=3)
    assert stripped(index, docs) == [("ab\nÄÖ", 3, 1)] * 3


def test_odd_rows_extra_columns_and_empty_tables(spark, tricky):
    index = LineIndex.build(tricky, threshold=2)
    for allowed in (64 << 20, -1):
        rows = index.strip(tricky, broadcast_bytes=allowed)
        kept = [c for c in tricky.columns if c not in ("n_lines", "n_dropped")]
        assert rows.columns == [*kept, "n_lines", "n_dropped"]
        found = sorted(map(tuple, rows.select("text", "n_lines", "n_dropped").collect()))
        assert found == brute([r.text for r in tricky.select("text").collect()], 2)
    none = tricky.limit(0)
    empty = LineIndex.build(none)
    assert empty.strip(none).count() == 0 and count_lines(none).count() == 0
    assert empty.insert(tricky).strip(tricky).count() == tricky.count()


def test_cuckoo_filter_holds_what_it_was_given():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    held = built(keys)
    assert held.contains(keys).all()
    assert held.contains(rng.integers(0, 2**64, 100_000, dtype=np.uint64)).sum() < 10
    held.delete(keys[:9000])
    again = CuckooFilter.from_bytes(held.to_bytes())
    assert again.contains(keys[9000:]).all() and again.size == 11_000
    assert again.contains(keys[:9000]).sum() < 10
    with pytest.raises(KeyError):
        CuckooFilter(4).delete(keys[:1])
