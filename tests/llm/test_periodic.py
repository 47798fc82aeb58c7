import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import periodic, queries


def walked(words, min_words=6, min_exponent=4):
    """All runs of one text, diagonal by diagonal and period by period."""
    found = []
    for q in range(1, len(words) // min_exponent + 1):
        at = 0
        while at + q < len(words):
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            length = at - start + q
            if at > start and length >= max(min_words, min_exponent * q):
                run = words[start : start + length]
                if not any(run[p:] == run[:-p] for p in range(1, q)):
                    found.append((start, length, q))
            at += at == start
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def drawn(chance):
    """Words with repeats of repeats."""
    words = []
    while len(words) < chance.choice([0, 8, 60, 250]):
        letters = "abcdefgh"[: chance.choice([1, 2, 2, 3, 8])]
        unit = [chance.choice(letters) for _ in range(chance.randrange(1, 25))]
        words += unit * chance.randrange(1, 8) + unit[: chance.randrange(len(unit) + 1)]
    return words


@pytest.mark.parametrize("min_words, min_exponent", [(6, 4), (1, 4), (9, 3), (6, 6)])
def test_against_all_diagonals(min_words, min_exponent):
    chance = random.Random(min_words * 10 + min_exponent)
    for _ in range(150):
        docs = [drawn(chance) for _ in range(3)]
        docs += docs[:1]
        numbers = np.array([ord(w) for d in docs for w in d], np.int64)
        owner = np.repeat(np.arange(4), [len(d) for d in docs])
        expected, base = [], 0
        for words in docs:
            expected += [(base + s, n, q) for s, n, q in walked(words, min_words, min_exponent)]
            base += len(words)
        found = periodic.runs_of(numbers, owner, min_words, min_exponent)
        assert found == sorted(expected, key=lambda run: (run[0], run[2]))


def test_every_gram_of_a_double_cover_occurs_twice_within_a_period():
    """A period in which all five-word grams come twice, so that nearest copies mislead."""
    order, size = [], 5

    def lyndon(t, p, a):
        if t > size:
            if size % p == 0:
                order.extend(a[1 : p + 1])
            return
        a[t] = a[t - p]
        lyndon(t + 1, p, a)
        for bit in range(a[t - p] + 1, 2):
            a[t] = bit
            lyndon(t + 1, t, a)

    lyndon(1, 1, [0] * (size + 1))
    unit = order + [1 - b for b in order]
    words = np.array(unit * 5, np.int64)
    found = periodic.runs_of(words, np.zeros(len(words), np.int64))
    assert found == walked(words.tolist())


def expected_row(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = walked(words)
    best = (None,) * 4
    if runs:
        from fractions import Fraction

        s, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, collapsed(words, runs))]
    return (doc_id, len(runs), *best, *digest)


def test_the_query_against_all_diagonals(spark, sf_dir, documents):
    found = queries.QUERIES["op11_periodic_runs"](spark, sf_dir)
    assert found.columns == (
        "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    )
    found = {row.doc_id: tuple(row) for row in found.collect()}
    rows = {r.doc_id: r.text for r in documents.collect()}
    assert set(found) == set(rows)
    # All diagonals of the longest texts would take minutes.
    short = [i for i, text in rows.items() if len(words_of(text)) < 1500]
    assert len(short) > 0.9 * len(rows)
    for i in short:
        assert found[i] == expected_row(i, rows[i])
    assert sum(found[i][1] > 0 for i in short) > 5


def test_odd_rows(spark, tricky):
    odd = tricky.where("text IS NULL OR length(text) < 10000")
    runs = spark.createDataFrame([(10, "la " * 50 + "end"), (11, " a a a a a a\n")], "doc_id long, text string")
    found = periodic.find(odd.select("doc_id", "text").unionAll(runs))
    key = lambda r: repr(tuple(r))
    rows = sorted(((r.key, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=key)
    expected = []
    for r in [*odd.collect(), *runs.collect()]:
        words = words_of(r.text)
        spans = walked(words)
        expected.append((r.doc_id, len(words), spans, collapsed(words, spans)))
    assert rows == sorted(expected, key=key)
    # Long texts, clashing names and no rows.
    assert periodic.find(tricky).agg(F.sum("n_words")).first()[0] > 60_000
    assert periodic.find(tricky.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find(tricky, min_exponent=2)


def test_a_long_text_of_one_word(spark):
    docs = spark.range(1).select(
        F.lit(1).alias("doc_id"), F.expr("repeat('la ', 2000000)").alias("text")
    )
    row = periodic.find(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 2_000_000, 1)] and row.collapsed == "la"
