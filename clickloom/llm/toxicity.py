"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's probability is logistic in the words it holds (as words and by how they begin); a
document is toxic unless all its sentences are clean, so its score is the noisy-or of theirs. The
weights are fitted to document labels through that formula. Scoring takes whole texts, and points to
the sentences that make a document toxic.

Fitting uses at most ``most_rows`` labelled rows, those whose keys hash lowest, and at most
``most_features`` features, those that the labels bear out most; counts for the choice are made by
Spark over these rows. Only text is an input of the score.

Defined cases: a null or empty text has no sentence and scores 0; rows without a label, or with a
null key, are not learned from; a key with several labels is toxic if one says so; without labels of
both kinds every score is 0. Equal texts score alike; texts of any length are taken whole. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.texts import as_bytes, lowest
from clickloom.session import stored

#: A-Z to lower case, ends of sentences to line feeds, other ASCII signs to spaces.
SENTENCE_BYTES = bytes(
    10
    if i in b".!?\n"
    else i + 32
    if 65 <= i <= 90
    else i
    if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128
    else 32
    for i in range(256)
)
PREFIXES = (4, 5, 6)
_CACHE = 1 << 20
L2 = 1e-6


def features(word: bytes) -> list[bytes]:
    """A word and its beginnings."""
    return [b"=" + word, *(b"^" + word[:size] for size in PREFIXES if len(word) > size)]


class _Weights(dict):
    """The weight of each word, from its features."""

    def __init__(self, by_feature: dict[bytes, float]):
        super().__init__()
        self.by_feature = by_feature

    def __missing__(self, word: bytes) -> float:
        if len(self) > _CACHE:
            self.clear()
        weight = self[word] = sum(self.by_feature.get(f, 0.0) for f in features(word))
        return weight


@dataclass(frozen=True)
class Model:
    """Weights of features and of being a sentence at all."""

    bias: float
    by_feature: dict[bytes, float]

    def opened(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """A model with the words it has met in a task."""

    def __init__(self, model: Model):
        self.bias = model.bias
        self.weights = _Weights(model.by_feature)
        self.idle = math.log1p(math.exp(min(model.bias, 30.0)))

    def sentences(self, text: bytes | None) -> tuple[int, list[tuple[int, int, float]]]:
        """How many sentences there are; byte range and log-odds of those with a weighty word."""
        plain, weight = (text or b"").translate(SENTENCE_BYTES), self.weights.__getitem__
        parts = plain.split(b"\n")
        count = sum(1 for part in parts if part and not part.isspace())
        if not any(map(weight, plain.split())):
            return count, []
        found, at = [], 0
        for part in parts:
            odds = sum(map(weight, set(part.split())))
            if odds:
                found.append((at, at + len(part), self.bias + odds))
            at += len(part) + 1
        return count, found

    def score(self, text: bytes | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability of the text, and byte range and probability of its weighty sentences."""
        count, found = self.sentences(text)
        clean = (count - len(found)) * self.idle
        for _, _, odds in found:
            clean += odds if odds > 30 else math.log1p(math.exp(odds))
        parts = [(a, b, 1 / (1 + math.exp(-max(min(odds, 500), -500)))) for a, b, odds in found]
        return -math.expm1(-clean), parts


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, most_rows: int) -> DataFrame:
    """Text and label of the rows to learn from; labels has the key and whether it is toxic."""
    known = (
        labels.filter("key is not null and toxic is not null")
        .groupBy("key")
        .agg(F.max("toxic").alias("toxic"))
    )
    known = lowest(known, "key", most_rows, known.count())
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    # At most most_rows keys with a flag: small whatever the corpus, so the texts stay in place.
    flagged = F.broadcast(known)
    rows = texts.join(flagged, "key").select(
        F.xxhash64("key", "text").alias("mark"), "text", F.col("toxic").cast("int").alias("toxic")
    )
    # Rows may share a key, so they are bounded once more.
    held = texts.select("key").join(flagged, "key").count()
    if held > most_rows:
        rows = lowest(rows, "mark", most_rows, held)
    return stored(rows.select("text", "toxic"), "toxic-sample")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and toxic rows with each feature."""
    for batch in batches:
        held, toxic = Counter(), Counter()
        for text, label in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
            words = set((text or b"").translate(SENTENCE_BYTES).split())
            own = {f for word in words for f in features(word)}
            held.update(own)
            if label:
                toxic.update(own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), pa.binary()),
                pa.array(list(held.values()), pa.int64()),
                pa.array([toxic[f] for f in held], pa.int64()),
            ],
            ["feature", "n", "x"],
        )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    most_rows: int = 20_000,
    most_features: int = 2048,
    steps: int = 300,
) -> Model:
    """Weights by gradient descent on the noisy-or likelihood of document labels."""
    rows = _sample(docs, labels, key, text, most_rows)
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("x")).first()
    if not total.n or not total.x or total.x == total.n:
        return Model(-math.inf, {})
    rate = total.x / total.n
    n, x = F.col("n"), F.col("x")
    strength = F.abs(x - n * rate) / F.sqrt(n * rate * (1 - rate))
    chosen = (
        rows.mapInArrow(_counted, "feature binary, n long, x long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        .filter(n >= 5)
        .withColumn("strength", strength)
        .filter("strength >= 4")
        .orderBy(F.desc("strength"), "feature")
        .limit(most_features)
        .select("feature")
        .collect()
    )
    numbers = {bytes(row.feature): i for i, row in enumerate(chosen)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for value in as_bytes(batch.column(0)):
                parts = [p.split() for p in (value or b"").translate(SENTENCE_BYTES).split(b"\n")]
                own = [
                    sorted(
                        numbers[f] for w in set(part) for f in features(w) if f in numbers
                    )
                    for part in parts
                    if part
                ]
                counts.append(len(own))
                found.append([one for one in own if one])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array(counts, pa.int64()),
                    pa.array(found, pa.list_(pa.list_(pa.int32()))),
                ],
                ["toxic", "n", "bags"],
            )

    # Bounded: at most most_rows rows, with the numbers of chosen features alone.
    held = rows.mapInArrow(bags, "toxic int, n long, bags array<array<int>>").collect()
    return _descended(held, [bytes(row.feature) for row in chosen], rate, steps)


def _descended(rows: list, names: list[bytes], rate: float, steps: int) -> Model:
    labels = np.array([row.toxic for row in rows], bool)
    idle = np.array([row.n - len(row.bags) for row in rows], float)
    owner = np.repeat(np.arange(len(rows)), [len(row.bags) for row in rows])
    bags = [bag for row in rows for bag in row.bags]
    of_bag = np.repeat(np.arange(len(bags)), list(map(len, bags)))
    feature = np.array([f for bag in bags for f in bag], int)
    mean = max(1.0, float(np.mean([row.n for row in rows])))
    # Start at half the log-odds of each feature alone; the last is the bias.
    with_it = [np.unique(owner[of_bag[feature == f]]) for f in range(len(names))]
    bad = np.array([labels[docs].sum() for docs in with_it], float)
    all_ = np.array([len(docs) for docs in with_it], float)
    value = np.append(
        0.5 * (np.log((bad + 0.5) / (all_ - bad + 0.5)) - math.log(rate / (1 - rate))), 0.0
    )
    value[-1] = math.log(max(rate, 1e-6) / mean)
    first, second = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, steps + 1):
        odds = value[-1] + np.bincount(of_bag, value[feature], len(bags))
        chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        base = 1 / (1 + math.exp(-value[-1]))
        clean = np.bincount(owner, np.logaddexp(0, odds), len(rows)) + idle * np.logaddexp(
            0, value[-1]
        )
        # The slope of the loss by the sum of soft-plus: 1 if clean, -(1 - p) / p if toxic.
        slope = np.where(labels, -1 / np.expm1(np.clip(clean, 1e-9, 500)), 1.0) / len(rows)
        by_bag = slope[owner] * chance
        grad = np.append(
            np.bincount(feature, by_bag[of_bag], len(names)),
            by_bag.sum() + (slope * idle).sum() * base,
        )
        grad[:-1] += L2 * value[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        value -= 0.1 * move
    weights = {name: float(w) for name, w in zip(names, value) if abs(w) > 1e-3}
    return Model(float(value[-1]), weights)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, score, and the byte range and probability of each weighty sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.opened()
        for batch in batches:
            found = [scorer.score(value) for value in as_bytes(batch.column(1))]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in s] for _, s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([p for p, _ in found], pa.float64()),
                    pa.array(spans, kind),
                ],
                ["key", "score", "sentences"],
            )

    kind = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    )
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    of_key = named.schema["key"].dataType.simpleString()
    return named.mapInArrow(
        scored,
        f"key {of_key}, score double, sentences array<struct<start:long,end:long,score:double>>",
    )


def offending(sentences: Column, limit: float = 0.3) -> Column:
    """The sentences at or over a probability, the worst first."""
    worst = F.transform(
        F.filter(sentences, lambda s: s["score"] >= limit),
        lambda s: F.struct((-s["score"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return F.transform(
        F.array_sort(worst), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    )
