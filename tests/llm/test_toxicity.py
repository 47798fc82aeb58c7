import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import toxicity
from clickloom.llm.queries import QUERIES

MODEL = toxicity.Model(-4.0, {b"=idiot": 6.0, b"^lowe": 5.0, b"=nice": -3.0})


def brute(text):
    clean = 1.0
    for part in (text or "").replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
        words = set(part.lower().replace(",", " ").split())
        if words:
            odds = -4.0 + sum(
                6.0 * (w == "idiot") + 5.0 * (w[:4] == "lowe" and len(w) > 4) - 3.0 * (w == "nice")
                for w in words
            )
            clean *= 1 - 1 / (1 + math.exp(-odds))
    return 1 - clean


@pytest.mark.parametrize(
    "text",
    ["", None, "Plain. Words. Here", "An IDIOT, idiot! Nice.", "loweich lowe\nnice idiot? a b", "."],
)
def test_score_is_the_noisy_or_of_sentences(spark, text):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = toxicity.score(frame, MODEL).first()
    assert row.score == pytest.approx(brute(text), abs=1e-9)


def test_offending_sentences_are_located(spark):
    text = "Ein é Satz. You idiot, you! All fine here.\nloweich."
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    scored = toxicity.score(frame, MODEL).select(
        toxicity.offending(F.col("sentences")).alias("found")
    )
    raw = text.encode()
    found = [raw[s.start : s.end].decode().strip() for s in scored.first().found]
    assert found == ["You idiot, you", "loweich"]


def test_held_out_documents_are_told_apart(spark):
    """Toxic words are in one sentence of many; only document labels are given."""
    rng = np.random.default_rng(1)
    words = [f"wort{i}" for i in range(400)]
    docs, labels = [], []
    for key in range(1500):
        parts = [" ".join(rng.choice(words, 8)) for _ in range(rng.integers(1, 12))]
        toxic = bool(rng.random() < 0.2)
        if toxic:
            at = rng.integers(0, len(parts))
            parts[at] += " " + rng.choice(["vilea", "vileb", "vilec", "scum"])
        docs.append((key, ". ".join(parts)))
        labels.append((key, toxic))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels[:1000], "key long, toxic boolean")
    model = toxicity.fit(frame, known)
    score = {r.key: r.score for r in toxicity.score(frame, model).collect()}
    wrong = sum((score[key] >= 0.3) != toxic for key, toxic in labels[1000:])
    assert wrong <= 5


def test_query_learns_from_the_rest_alone(spark, sf_dir):
    rows = QUERIES["op5_toxicity"](spark, sf_dir).collect()
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.3)


def test_odd_rows_extra_columns_and_empty_tables(spark, tricky):
    known = spark.createDataFrame(
        [(1, True), (1, None), (3, False), (None, True), (5, True), (6, False)],
        "key long, toxic boolean",
    )
    model = toxicity.fit(tricky, known)
    rows = toxicity.score(tricky, model).collect()
    assert len(rows) == tricky.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if r.key in (1, 2, 4, 9))
    for few in (known.limit(0), known.filter("toxic")):
        blank = toxicity.fit(tricky, few)
        assert {r.score for r in toxicity.score(tricky, blank).collect()} == {0.0}
    assert toxicity.score(tricky.limit(0), model).count() == 0


def test_a_labelled_key_that_many_rows_share_is_bounded(spark):
    docs = spark.range(5000).selectExpr(
        "if(id < 4000, 1L, id) AS key", "concat('text number ', id) AS text"
    )
    labels = docs.select("key").distinct().selectExpr("key", "key % 2 = 0 AS toxic")
    sample = toxicity._sample(docs, labels, "key", "text", 300)
    assert sample.count() == 300
    again = toxicity._sample(docs.repartition(7), labels, "key", "text", 300)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sample.collect()))
