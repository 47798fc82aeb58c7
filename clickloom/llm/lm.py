"""Language-model scores by logistic context mixing over the words in their order, gated by the kind of document.

Words (runs of what is no white space, A-Z in lower case) and an end make up a text. The words of all
training documents are counted, over the whole corpus and by document class. The most frequent words
are the leaves of a tree, and a text is coded word by word through its decisions by
:mod:`clickloom.llm.sequence`: from the counts of the class that the words before speak for, and from what
came after the same one and the same two words before, counted over all training documents in their order.
A word that is no leaf is coded by an escape and spelled: the counts of all words fill the bit predictors of
:mod:`clickloom.llm.mixing`, which price every distinct word once. Their mixing weights tasks learn side by side,
online, and the means are the model; those over sequences are fitted to sums of what all tasks count.

All that is learned is learned from all training documents. Classes (of hashed bags of words) start from
``sample_rows`` documents whose keys hash lowest, and are then the middles of all documents that are nearest. The
weights over sequences are fitted to all decisions, those inside words are learned online from all words, by how
often they come. Tables have a fixed number of slots, and the tree holds the ``tree_words`` most frequent words; any
word is a context, and the longest context inside a word holds all words. All counts are of all training
documents. The prices of at most ``broadcast_words`` words beside the tree's go to every task, and the task
that reads a document adds up all but its rare words; only these are joined with their prices, and no word
of which a third of all rows could consist is among them.

Defined cases: a null or empty text is the end alone; equal rows are scored alike; very long words are coded in pieces; without training documents nothing is known and every bit costs about
one; an empty table gives no rows. Columns other than key and text are not read.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm import mixing, sequence
from clickloom.llm.texts import lowest
from clickloom.session import stored

END = b"\n"
CLASSES, HASHED = 8, 2048
_BLOCK = 1 << 16
#: Bytes of text that are cut into words at once, which bounds what a task holds of them.
_TOGETHER = 1 << 20
_CLASS_NAMES = [f"c{k}" for k in range(CLASSES)]


def _listed(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _together(batches: Iterator[pa.RecordBatch], rows: int = 40_000) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows and more, since words share more beginnings the more there are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(part.num_rows for part in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


@dataclass
class Words:
    """Texts as numbers of their words in order; ``distinct`` holds each word once, the end last."""

    distinct: pa.Array
    numbers: np.ndarray
    sizes: np.ndarray

    @cached_property
    def spelled(self) -> list[bytes]:
        return _listed(self.distinct)

    @cached_property
    def firsts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @cached_property
    def text(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @cached_property
    def places(self) -> np.ndarray:
        """The distinct words' places in a bag."""
        return np.fromiter(map(zlib.crc32, self.spelled), np.int64, len(self.spelled)) % HASHED

    @staticmethod
    def of(column: pa.Array) -> "Words":
        """Arrow cuts texts at white space, and Python sees each distinct word once."""
        if pa.types.is_binary(column.type):
            column = column.cast(pa.string())
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
        sizes = np.diff(cut.offsets.to_numpy()).astype(np.int64)
        flat = cut.flatten()
        held = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not held.all():
            # White space at either end leaves an empty piece.
            whose = np.repeat(np.arange(len(sizes)), sizes)
            sizes = np.bincount(whose[held], minlength=len(sizes))
            flat = flat.filter(pa.array(held))
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary())
        sizes = sizes + 1
        numbers = np.full(int(sizes.sum()), len(distinct), np.int64)
        inside = np.ones(len(numbers), bool)
        inside[np.cumsum(sizes) - 1] = False
        numbers[inside] = coded.indices.to_numpy()
        return Words(pa.concat_arrays([distinct, pa.array([END], pa.binary())]), numbers, sizes)

    def bags(self, low: int, high: int) -> np.ndarray:
        """Some of the texts' words, counted by hash."""
        part = slice(self.firsts[low], self.firsts[high - 1] + self.sizes[high - 1])
        cells = (self.text[part] - low) * HASHED + self.places[self.numbers[part]]
        return np.bincount(cells, minlength=(high - low) * HASHED).reshape(-1, HASHED)


def cut_texts(column: pa.Array, most: int = _TOGETHER) -> Iterator[tuple[int, Words]]:
    """The words of texts, so many bytes of text at a time, at least one text; and the first text's row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, Words.of(column.slice(at, to - at))
        at = to


class Gate:
    """Which class a document is most like: a mixture of multinomials over hashed words."""

    def __init__(self, bags: np.ndarray, rounds: int = 20):
        rng = np.random.default_rng(0)
        sums = bags.sum(1, keepdims=True)
        shape = np.sqrt(bags / np.maximum(sums, 1))
        shape /= np.maximum(np.linalg.norm(shape, axis=1, keepdims=True), 1e-9)
        # Start from documents far from each other, then let each class be the mean of its own.
        centers = shape[:1] if len(shape) else np.zeros((1, HASHED))
        for _ in range(CLASSES - 1):
            far = 1 - (shape @ centers.T).max(1) if len(shape) else np.zeros(0)
            if far.sum() <= 1e-9:
                break
            pick = rng.choice(len(shape), p=np.maximum(far, 0) / np.maximum(far, 0).sum())
            centers = np.vstack([centers, shape[pick]])
        for _ in range(rounds):
            own = (shape @ centers.T).argmax(1)
            centers = np.stack(
                [
                    shape[own == k].mean(0) if (own == k).any() else centers[k]
                    for k in range(len(centers))
                ]
            )
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
        self.centers = centers.T.astype(np.float32)

    def dealt(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The class of each text, and the texts as roots of their bags."""
        centers = self.centers.astype(float)
        for at in range(0, len(words.sizes), 256):
            roots = np.sqrt(words.bags(at, min(at + 256, len(words.sizes))))
            # Rounded, so that no class hangs on what else is in the table.
            yield (roots @ centers).astype(np.float32).argmax(1), roots

    def of(self, words: Words) -> np.ndarray:
        """The class of each text."""
        return np.concatenate([own for own, _ in self.dealt(words)])

    def sums(self, words: Words) -> np.ndarray:
        """What the classes' texts add up to, each of length one."""
        found = np.zeros((CLASSES, HASHED))
        for own, roots in self.dealt(words):
            roots /= np.maximum(np.linalg.norm(roots, axis=1, keepdims=True), 1e-9)
            found += (np.arange(CLASSES)[:, None] == own).astype(float) @ roots
        return found

    def moved(self, sums: np.ndarray) -> "Gate":
        """Each class in the middle of its texts, one without texts where it was."""
        size = np.linalg.norm(sums[: self.centers.shape[1]], axis=1, keepdims=True).T
        middle = sums[: self.centers.shape[1]].T / np.maximum(size, 1e-9)
        found = Gate(np.zeros((0, HASHED)), 0)
        found.centers = np.where(size > 0, middle, self.centers).astype(np.float32)
        return found


def _texts(docs: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    return docs.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{text}`").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )


def _gate(texts: DataFrame, sample_rows: int) -> Gate:
    """Classes that start from a sample, each then in the middle of all its training documents."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in cut_texts(batch.column(0)):
                for at in range(0, len(words.sizes), 256):
                    bags = words.bags(at, min(at + 256, len(words.sizes))).astype("<f4")
                    found = [bag.tobytes() for bag in bags]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["bag"])

    trained = texts.filter("train")
    chosen = lowest(trained, "key", sample_rows, trained.count()).select("text")
    rows = chosen.mapInArrow(bags, "bag binary").collect()
    found = [np.frombuffer(row.bag, "<f4") for row in rows]
    gate = Gate(np.array(found, float).reshape(-1, HASHED))
    shared = texts.sparkSession.sparkContext.broadcast(gate)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, HASHED))
        for batch in batches:
            for _, words in cut_texts(batch.column(0)):
                sums += shared.value.sums(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CLASSES), pa.int32()), pa.array([part.tobytes() for part in sums], pa.binary())],
            ["kind", "content"],
        )

    def summed(parts: pd.DataFrame) -> pd.DataFrame:
        # The order of the tasks is no part of the result.
        total = sum(np.frombuffer(content) for content in sorted(parts.content))
        return pd.DataFrame({"kind": [int(parts.kind.iloc[0])], "content": [total.tobytes()]})

    schema = "kind int, content binary"
    parts = trained.select("text").mapInArrow(added, schema).groupBy("kind").applyInPandas(summed, schema)
    sums = np.zeros((CLASSES, HASHED))
    for row in parts.collect():
        sums[row.kind] = np.frombuffer(row.content)
    return gate.moved(sums)


def count_words(texts: DataFrame, gate: Gate) -> DataFrame:
    """Every word of every document, with its count in the training documents of each class."""
    shared = texts.sparkSession.sparkContext.broadcast(gate)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trained = batch.column(1).to_numpy(zero_copy_only=False)
            for at, words in cut_texts(batch.column(0), 4 * _TOGETHER):
                train = trained[at : at + len(words.sizes)]
                # The last is for other documents: their words, without a count.
                kinds = np.where(train, shared.value.of(words), CLASSES)
                cells = words.numbers * (CLASSES + 1) + kinds[words.text]
                counts = np.bincount(cells, minlength=len(words.distinct) * (CLASSES + 1))
                counts = counts.reshape(-1, CLASSES + 1)
                columns = [pa.array(np.ascontiguousarray(counts[:, k])) for k in range(CLASSES)]
                yield pa.RecordBatch.from_arrays([words.distinct, *columns], ["word", *_CLASS_NAMES])

    schema = ", ".join(["word binary", *(f"{name} long" for name in _CLASS_NAMES)])
    rows = texts.select("text", "train").mapInArrow(counted, schema)
    summed = rows.groupBy("word").agg(*(F.sum(name).alias(name) for name in _CLASS_NAMES))
    summed = summed.withColumn("c", sum((F.col(name) for name in _CLASS_NAMES), F.lit(0)).cast("long"))
    return stored(summed, "word-counts")


def _frequent(words: DataFrame, most: int) -> Column:
    """Whether a word is one of about so many that come most often, equals by their hash.

    From a histogram of counts by size, to a sixteenth of a power of two, which has a bounded number of rows.
    """
    size = F.ceil(16 * F.log2(F.col("c") + 1))
    rows = words.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()
    held, found = 0, F.lit(False)
    for row in sorted(rows, key=lambda row: -row["size"]):
        if held + row.n > most:
            hashed = F.xxhash64("word") / float(1 << 64) + 0.5
            return found | ((size == row["size"]) & (hashed < (most - held) / row.n))
        held += row.n
        found = size >= row["size"]
    return found


def _tables(known: DataFrame, task_words: int) -> list[np.ndarray]:
    """The predictors' counts over all words; a task sends what it has by blocks of slots."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = mixing.empty()
        for batch in _together(batches):
            counts = batch.column(1).to_numpy()
            mixing.add(tables, _listed(batch.column(0)), counts, np.ones(len(counts), bool))
        for order, table in enumerate(tables):
            for start in range(0, len(table), _BLOCK):
                part = table[start : start + _BLOCK]
                held = np.flatnonzero(part.any(1))
                if len(held):
                    content = held.astype("<u2").tobytes() + part[held].astype("<f4").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([order], pa.int32()),
                            pa.array([start // _BLOCK], pa.int32()),
                            pa.array([len(held)], pa.int32()),
                            pa.array([content], pa.binary()),
                        ],
                        ["order", "block", "held", "content"],
                    )

    def summed(parts: pd.DataFrame) -> pd.DataFrame:
        order, block = int(parts.order.iloc[0]), int(parts.block.iloc[0])
        total = np.zeros((min(_BLOCK, 1 << mixing.BITS[order]), 2))
        for held, content in zip(parts.held, parts.content):
            places = np.frombuffer(content, "<u2", held)
            total[places] += np.frombuffer(content, "<f4", 2 * held, 2 * held).reshape(-1, 2)
        content = zlib.compress(mixing.squeezed(total).tobytes(), 1)
        return pd.DataFrame({"order": [order], "block": [block], "content": [content]})

    tasks = max(1, round(known.count() / task_words))
    rows = known.select("word", "c").repartition(tasks, "word")
    parts = rows.mapInArrow(blocks, "order int, block int, held int, content binary")
    done = parts.groupBy("order", "block").applyInPandas(
        summed, "order int, block int, content binary"
    )
    tables = [np.zeros((1 << b, 2), np.uint16) for b in mixing.BITS]
    # A fixed number of blocks, whatever the corpus.
    for row in stored(done, "predictors").toLocalIterator():
        found = np.frombuffer(zlib.decompress(row.content), np.uint16).reshape(-1, 2)
        tables[row.order][row.block * _BLOCK : row.block * _BLOCK + len(found)] = found
    return tables


def _mixer(
    known: DataFrame, tables: list[np.ndarray], task_words: int
) -> mixing.Mixer:
    """The mean of what tasks learn, each over all words of its share of the training words."""
    shared = known.sparkSession.sparkContext.broadcast(tables)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            # In an order that does not hang on how they came.
            rows = pa.Table.from_batches(held).sort_by("word")
            words, counts = rows["word"].to_pylist(), rows["c"].to_numpy()
            number = TaskContext.get().partitionId()
            found = mixing.learned(shared.value, words, counts, None, number)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number % 64], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())],
                ["part", "content"],
            )

    def met(parts: pd.DataFrame) -> pd.DataFrame:
        found = mixing.averaged([pickle.loads(content) for content in parts.content])
        content = pickle.dumps((len(parts), found))
        return pd.DataFrame({"content": [content]})

    tasks = max(1, round(known.count() / task_words))
    rows = known.select("word", "c").repartition(tasks, "word")
    parts = rows.mapInArrow(learned, "part int, content binary")
    found = parts.groupBy("part").applyInPandas(met, "content binary").collect()
    mixers = [pickle.loads(content) for content in sorted(bytes(row.content) for row in found)]
    return mixing.averaged([mixer for number, mixer in mixers for _ in range(number)])


def _priced(words: DataFrame, prices: mixing.Prices, shares: np.ndarray) -> DataFrame:
    """Words with log2 probability and, in the bytes of a number, what each class makes of them:
    sixteenths of the log2 of the class's share, as it would be in a word without counts."""
    shared = words.sparkSession.sparkContext.broadcast(prices)

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches):
            held = _listed(batch.column(0))
            price = shared.value.price(held) if held else np.zeros(0)
            counts = np.stack([batch.column(1 + k).to_numpy() for k in range(CLASSES)], 1)
            share = (counts + 2.0 * shares) / (counts.sum(1, keepdims=True) + 2.0)
            steps = np.clip(np.rint(-16 * np.log2(share)), 0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1 + CLASSES),
                    pa.array(price, pa.float64()),
                    pa.array(np.ascontiguousarray(steps).view("<i8").ravel(), pa.int64()),
                ],
                ["word", "c", "price", "steps"],
            )

    rows = words.select("word", *_CLASS_NAMES, "c")
    rows = rows.mapInArrow(done, "word binary, c long, price double, steps long")
    return stored(rows, "word-prices")


def score(
    docs: DataFrame,
    train: Column,
    key: str = "doc_id",
    text: str = "text",
    sample_rows: int = 2048,
    task_words: int = 400_000,
    broadcast_words: int = 1 << 18,
    tree_words: int = 1 << 16,
) -> DataFrame:
    """Key, training flag, token counts, training tokens, the add-one unigram's log10 and the
    model's, and the model's bits per byte, for every document.

    ``train`` is a condition on the columns of ``docs``.
    """
    spark = docs.sparkSession
    texts = _texts(docs, key, text, train)
    words = count_words(texts, _gate(texts, sample_rows))
    known = words.filter("c > 0")
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ["c", *_CLASS_NAMES]]
    once = F.count(F.when(F.col("c") == 1, 1)).alias("once")
    total = known.agg(F.count("*").alias("distinct"), once, *sums).first()
    by_class = np.array([total[name] for name in _CLASS_NAMES], float)
    shares = (by_class + 1e-3) / (by_class + 1e-3).sum()
    if total.distinct:
        tables = _tables(known, task_words)
        mixer = _mixer(known, tables, task_words)
    else:
        tables = [np.zeros((1 << b, 2), np.uint16) for b in mixing.BITS]
        mixer = mixing.Mixer.fresh()
    prices = mixing.Prices.of(tables, mixer)
    del tables
    priced = _priced(words, prices, shares)

    base_of = 1.0 / (total.c + total.distinct + 1.0)
    unseen = np.clip(np.rint(-16 * np.log2(shares)), 0, 255).astype(np.int64)
    leads = (F.col("c") > 0) & _frequent(known, tree_words)
    lead = priced.filter(leads).toArrow().to_pylist()
    lead.sort(key=lambda row: (-row["c"], row["word"]))
    counts = np.array([row["c"] for row in lead], float)
    steps = np.array([row["steps"] for row in lead], "<i8").view(np.uint8).reshape(-1, CLASSES)
    # How often each leaf comes in each class; what is no leaf, and what will be new, is the escape.
    masses = counts[:, None] * np.exp2(steps / -16.0)
    rest = np.maximum(by_class - masses.sum(0), 0) + (total.once + 1) * shares
    masses = np.vstack([masses, rest])
    tree = sequence.Tree.of(masses.sum(1))
    reader = Reader([row["word"] for row in lead], unseen - steps.astype(np.int64), unseen)
    odds = tree.odds(masses)
    # What is left of all spellings for words that are no leaves.
    spelled = math.log2(max(1 - sum(2.0 ** row["price"] for row in lead), 1e-9))
    del lead
    trained = texts.filter("train")
    counted = _sequence_tables(trained, reader, tree, total.c)
    weights = _sequence_weights(trained, reader, tree, odds, counted, total.c)
    model = sequence.Model.of(tree, odds, counted, weights)
    del counted

    common = priced.filter(leads | _frequent(words, broadcast_words))
    summed = stored(_summed(texts, common, base_of, spelled, reader, model), "lm-sums")
    rare = (
        summed.filter("word is not null")
        .select("row", "word", "n")
        .join(priced.select("word", "c", "price"), "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * F.log10((F.col("c") + 1) * base_of)).alias("more_base"),
            F.sum(F.col("n") * (F.col("price") - spelled)).alias("more_log2"),
        )
    )
    whole = ["row", "key", "train", "n_tokens", "n_bytes", "n_known", "base", "log2"]
    rows = summed.filter("word is null").select(*whole).join(rare, "row", "left").fillna(
        0, ["more_known", "more_base", "more_log2"]
    )
    rows = rows.withColumn("log2", F.col("log2") + F.col("more_log2"))
    return rows.select(
        "key",
        "train",
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).cast("long").alias("n_known"),
        F.lit(int(total.c)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base")).alias("base_score"),
        (F.col("log2") * math.log10(2)).alias("score"),
        (-F.col("log2") / F.col("n_bytes")).alias("bits_per_byte"),
    )


class _Places(dict):
    """Numbers of common words; any other is -1."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Reader:
    """Texts as leaves of the tree, the contexts of their words, and the class at each word."""

    def __init__(self, words: list[bytes], speaks: np.ndarray, prior: np.ndarray):
        self.words = words
        #: For each class what each leaf says for it, in sixteenths of log2; the escape says nothing.
        speaks = np.vstack([speaks.reshape(-1, CLASSES), np.zeros((1, CLASSES), np.int64)])
        self.speaks = np.ascontiguousarray(speaks.T)
        self.prior = -prior

    def places(self, more: list[bytes] = []) -> _Places:
        """Numbers of the tree's words, and after these and the escape those of others."""
        held = _Places(zip(more, range(len(self.words) + 1, len(self.words) + 1 + len(more))))
        held.update(zip(self.words, range(len(self.words))))
        return held

    def read(self, places: _Places, words: Words) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Places of the distinct words; leaves and hashed contexts of all words."""
        count = len(words.spelled)
        place = np.fromiter(map(places.__getitem__, words.spelled), np.int64, count)
        escape = len(self.words)
        leaf = np.where((place < 0) | (place > escape), escape, place)
        name = leaf.copy()
        away = np.flatnonzero(leaf == escape)
        name[away] = [zlib.crc32(words.spelled[i]) + (1 << 32) for i in away.tolist()]
        hashed = sequence.contexts(name[words.numbers], words.firsts)
        return place, leaf[words.numbers], hashed

    def kinds(self, words: Words, leaves: np.ndarray) -> np.ndarray:
        """The class that the words before each word speak for; of equals the first."""
        kinds = np.empty(len(leaves), np.uint8)
        starts = np.empty((CLASSES, len(words.sizes)), np.int64)
        so_far = np.zeros(CLASSES, np.int64)
        for at in range(0, len(leaves), _BLOCK):
            held = leaves[at : at + _BLOCK]
            low, high = np.searchsorted(words.firsts, (at, at + len(held)))
            text = words.text[at : at + _BLOCK]
            best = None
            for k in range(CLASSES):
                said = self.speaks[k].take(held)
                sums = np.cumsum(said)
                sums += so_far[k]
                so_far[k] = sums[-1]
                sums -= said
                starts[k, low:high] = sums[words.firsts[low:high] - at]
                sums -= (starts[k] - self.prior[k]).take(text)
                # The class in the lowest bits, the first of equals the largest.
                sums *= CLASSES
                sums += CLASSES - 1 - k
                best = sums if best is None else np.maximum(best, sums, out=best)
            kinds[at : at + _BLOCK] = CLASSES - 1 - best % CLASSES
        return kinds


def _sequence_tables(
    trained: DataFrame, reader: Reader, tree: sequence.Tree, size: int
) -> list[np.ndarray]:
    """What came after one and two words, over all training documents; tasks of some million words
    send their sums by blocks of slots."""
    shared = trained.sparkSession.sparkContext.broadcast((reader, tree))
    block = 1 << 14

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, ways = shared.value
        places, tables, any_text = read.places(), sequence.empty(), False
        for batch in batches:
            for _, words in cut_texts(batch.column(0)):
                _, leaves, hashed = read.read(places, words)
                sequence.add(tables, ways, leaves, hashed)
                any_text = True
        for order, table in enumerate(tables if any_text else []):
            for start in range(0, len(table), 2 * block):
                content = table[start : start + 2 * block].astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([order], pa.int32()),
                        pa.array([start // (2 * block)], pa.int32()),
                        pa.array([content], pa.binary()),
                    ],
                    ["order", "block", "content"],
                )

    def summed(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(content, "<u4").astype(np.int64) for content in parts.content)
        content = zlib.compress(mixing.squeezed(total.reshape(-1, 2)).tobytes(), 1)
        place = {name: [int(parts[name].iloc[0])] for name in ("order", "block")}
        return pd.DataFrame({**place, "content": [content]})

    spark = trained.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, size >> 24)
    schema = "order int, block int, content binary"
    parts = trained.select("text").coalesce(tasks).mapInArrow(blocks, schema)
    done = parts.groupBy("order", "block").applyInPandas(summed, schema)
    tables = [np.zeros((1 << sequence.BITS, 2), np.uint16) for _ in range(2)]
    # A fixed number of blocks, whatever the corpus.
    for row in stored(done, "sequences").toLocalIterator():
        found = np.frombuffer(zlib.decompress(row.content), np.uint16).reshape(-1, 2)
        tables[row.order][row.block * block : (row.block + 1) * block] = found
    return tables


def _sequence_weights(
    trained: DataFrame,
    reader: Reader,
    tree: sequence.Tree,
    odds: np.ndarray,
    tables: list[np.ndarray],
    size: int,
) -> np.ndarray:
    """The weights that all training documents' decisions speak for; tasks send how often each kind came, by blocks."""
    held = sequence.Lessons.of(tables, odds)
    values = held.values
    shared = trained.sparkSession.sparkContext.broadcast((reader, tree, held))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, ways, lessons = shared.value
        places, counts = read.places(), np.zeros(sequence.CELLS, np.int64)
        for batch in batches:
            for _, words in cut_texts(batch.column(0)):
                _, leaves, hashed = read.read(places, words)
                kinds = read.kinds(words, leaves)
                counts += sequence.lessons(lessons, ways, leaves, hashed, kinds, words.text)
        for start in range(0, len(counts), _BLOCK):
            part = counts[start : start + _BLOCK]
            if part.any():
                content = zlib.compress(part.astype("<i8").tobytes(), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([start // _BLOCK], pa.int32()), pa.array([content], pa.binary())],
                    ["block", "content"],
                )

    def summed(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(content), "<i8") for content in parts.content)
        content = zlib.compress(total.astype("<i8").tobytes(), 1)
        return pd.DataFrame({"block": [int(parts.block.iloc[0])], "content": [content]})

    tasks = max(trained.sparkSession.sparkContext.defaultParallelism, size >> 22)
    schema = "block int, content binary"
    parts = trained.select("text").coalesce(tasks).mapInArrow(counted, schema)
    counts = np.zeros(sequence.CELLS, np.int64)
    # A fixed number of blocks, whatever the corpus.
    for row in parts.groupBy("block").applyInPandas(summed, schema).collect():
        found = np.frombuffer(zlib.decompress(row.content), "<i8")
        counts[row.block * _BLOCK : row.block * _BLOCK + len(found)] = found
    return sequence.fitted(counts, values)


def _summed(
    texts: DataFrame,
    common: DataFrame,
    base_of: float,
    spelled: float,
    reader: Reader,
    model: sequence.Model,
) -> DataFrame:
    """A row for each document with sums over its words, and one for each rare word."""
    rows = common.select("word", "c", "price").toArrow()
    kind = texts.schema["key"].dataType
    held = rows["word"].to_pylist()
    counts = rows["c"].to_numpy().astype(float)
    prices = np.column_stack([np.log10((counts + 1.0) * base_of), counts > 0, rows["price"].to_numpy() - spelled])
    # The tree's words first, which are not spelled, then a row that nothing refers to.
    at = {word: i for i, word in enumerate(held)}
    leads = [at[word] for word in reader.words]
    others = np.setdiff1d(np.arange(len(held)), leads)
    table = np.vstack([prices[leads] * [1, 1, 0], np.zeros((1, 3)), prices[others]])
    del rows, at
    shared = texts.sparkSession.sparkContext.broadcast(
        (reader, [held[i] for i in others.tolist()], table, model)
    )
    schema = (
        f"row long, key {kind.simpleString()}, train boolean, n_tokens long, n_bytes long,"
        " n_known long, base double, log2 double, word binary, n long"
    )
    names = ["row", "key", "train", "n_tokens", "n_bytes", "n_known", "base", "log2", "word", "n"]

    def rare_rows(words: Words, rare: np.ndarray, row: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Rare words in rows of their own, a bounded number at a time."""
        away = np.flatnonzero(rare[words.numbers])
        cells = np.sort(words.text[away] * len(words.distinct) + words.numbers[away])
        begins = np.flatnonzero(np.diff(cells, prepend=-1))
        times = np.diff(begins, append=len(cells))
        whose, number = np.divmod(cells[begins], len(words.distinct))
        for at in range(0, len(begins), 50_000):
            part = slice(at, at + 50_000)
            size = len(times[part])
            held = [pa.array(whose[part] + row), pa.nulls(size, kind)]
            held += [pa.nulls(size, pa.bool_()), *[pa.nulls(size, pa.int64())] * 3]
            held += [pa.nulls(size, pa.float64())] * 2
            held += [words.distinct.take(pa.array(number[part])), pa.array(times[part])]
            yield pa.RecordBatch.from_arrays(held, names)

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, more, figures, mixed = shared.value
        places = read.places(more)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            count = batch.num_rows
            sizes, lengths, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 3))]
            for at, words in cut_texts(batch.column(1)):
                place, leaves, hashed = read.read(places, words)
                # A rare word finds the row that nothing else refers to.
                rare = place < 0
                figure = figures[np.where(rare, len(read.words), place)][words.numbers]
                figure[:, 2] += mixed.price(leaves, hashed, read.kinds(words, leaves))
                sums.append(np.add.reduceat(figure, words.firsts, 0))
                sizes.append(words.sizes)
                long = pc.binary_length(words.distinct).to_numpy().astype(np.int64)[words.numbers]
                lengths.append(np.add.reduceat(long, words.firsts) + words.sizes - 1)
                yield from rare_rows(words, rare, row + at, batch.column(0).type)
            row += count
            total = np.concatenate(sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row - count, row), pa.int64()),
                    batch.column(0),
                    batch.column(2),
                    pa.array(np.concatenate(sizes)),
                    pa.array(np.concatenate(lengths)),
                    pa.array(total[:, 1].astype(np.int64)),
                    pa.array(np.ascontiguousarray(total[:, 0])),
                    pa.array(np.ascontiguousarray(total[:, 2])),
                    pa.nulls(count, pa.binary()),
                    pa.nulls(count, pa.int64()),
                ],
                names,
            )

    return texts.select("key", "text", "train").mapInArrow(done, schema)
