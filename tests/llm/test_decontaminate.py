import random
import re

import pytest

from clickloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    held, hit, owners = words(text), set(), set()
    for item, body in items:
        w = words(body)
        size = min(window, len(w))
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            for j in range(len(held) - size + 1):
                if held[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    owners |= {str(item)} - {"None"}
    return len(held), len(hit), sorted(owners)


@pytest.mark.parametrize("block_bytes", [16 << 20, 40])
def test_equals_brute_force_in_one_block_and_in_many(spark, block_bytes):
    rng = random.Random(7)
    pool = ["Alpha", "beta", "GAMMA", "delta!", "é", "x1", "beta"]
    items = [(i % 9, " ".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(14)]
    items += [(None, "alpha beta gamma delta"), (99, None), (100, "!!"), (3, "beta")]
    docs = [(i, "-".join(rng.choices(pool, k=rng.randint(0, 40)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(frame, table, window=4, block_bytes=block_bytes).collect()
    for row in found:
        expected = brute(row.text, items, 4)
        assert (row.found.n_words, row.found.n_hit, row.found.items) == expected
        raw = row.text.encode()
        spanned = [words(raw[s.start : s.end].decode()) for s in row.found.spans]
        assert sum(map(len, spanned)) == row.found.n_hit
    assert any(row.found.n_hit for row in found)


def test_spans_are_offsets_of_the_original(spark):
    docs = spark.createDataFrame([(1, "Ünd -- The QUICK,\nbrown fox? ja")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    (row,) = decontaminate.scan(docs, items).collect()
    (span,) = row.found.spans
    assert row.text.encode()[span.start : span.end].decode() == "The QUICK,\nbrown fox"


def test_odd_rows_extra_columns_and_empty_tables(spark, tricky):
    items = spark.createDataFrame(
        [(1, "one two three"), (1, "one two three"), (None, "and more"), (2, None), (3, "")],
        "item_id long, text string",
    )
    rows = decontaminate.scan(tricky, items)
    assert rows.columns == [*(c for c in tricky.columns if c != "found"), "found"]
    hits = {(r.doc_id, r.found.n_hit, tuple(r.found.items)) for r in rows.collect()}
    assert (3, 3, ("1",)) in hits and (8, 2, ()) in hits and (1, 0, ()) in hits
    kept = decontaminate.clean(tricky, items)
    assert kept.columns == tricky.columns and kept.count() == tricky.count() - 3
    assert decontaminate.scan(tricky.limit(0), items).count() == 0
    none = decontaminate.scan(tricky, items.limit(0))
    assert none.filter("found.n_hit > 0").count() == 0
