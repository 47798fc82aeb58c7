import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickloom.llm import lm, mixing, sequence
from clickloom.llm.queries import QUERIES


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def checked(rows, texts, trained):
    counts = Counter(w for key, text in texts.items() if trained(key) for w in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    for row in rows:
        words = tokens(texts[row.key])
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert (row.n_tokens, row.train_tokens) == (len(words), total)
        assert row.n_known == sum(w in counts for w in words)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert row.score < 0 and row.bits_per_byte > 0


@pytest.mark.parametrize("broadcast_words", [1 << 18, 50])
def test_base_figures_equal_brute_force(spark, documents, texts, broadcast_words):
    train = F.col("doc_id") % 7 != 2
    rows = lm.score(documents, train, broadcast_words=broadcast_words).collect()
    checked(rows, texts, lambda key: key % 7 != 2)
    assert len(rows) == len(texts)


def test_rare_words_by_join_give_the_same_scores(spark, documents):
    train = F.col("doc_id") % 7 != 2
    both = [
        {r.key: r.score for r in lm.score(documents, train, broadcast_words=n).collect()}
        for n in (1 << 18, 50)
    ]
    assert both[0].keys() == both[1].keys()
    assert all(both[0][k] == pytest.approx(both[1][k], rel=1e-9) for k in both[0])


def test_query_follows_its_folds(spark, sf_dir):
    for row in QUERIES["op9_lm_score"](spark, sf_dir).collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 7 == 2)


def small_model(words, counts):
    deep = np.ones(len(words), bool)
    tables = [mixing.squeezed(t) for t in mixing.counted(words, counts, deep)]
    mixer = mixing.averaged([mixing.learned(tables, words, counts, 4096, s) for s in (1, 2)])
    return mixing.Prices.of(tables, mixer)


def test_learning_beats_no_learning_and_prefers_what_was_seen():
    rng = np.random.default_rng(2)
    parts = [b"tion", b"er", b"an", b"st", b"re", b"ou", b"th"]
    words = [b"".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(3000)]
    held = Counter(words[:2500])
    known, counts = list(held), np.array(list(held.values()), float)
    prices = small_model(known, counts)
    fresh = words[2500:]
    learned = prices.price(fresh).sum()
    prices.mixer = mixing.Mixer.fresh()
    assert learned > prices.price(fresh).sum()
    junk = [bytes(rng.integers(33, 255, 8).astype(np.uint8)) for _ in range(500)]
    prices = small_model(known, counts)
    assert prices.price(fresh).mean() > prices.price(junk).mean() + 10


def test_probabilities_of_all_short_words_sum_to_less_than_one():
    prices = small_model([b"a", b"ab", b"b"], np.array([5.0, 3.0, 1.0]))
    short = [b"", *(bytes([i]) for i in range(256))]
    short += [bytes(p) for p in itertools.product(b"ab \n", range(256))]
    # A space ends a word, so nothing may follow it.
    short = [w for w in short if b" " not in w]
    total = np.exp2(prices.price(short)).sum()
    assert 0.5 < total <= 1.0


def test_pieces_of_long_words_add_up():
    prices = small_model([b"abc"], np.array([2.0]))
    long = b"xyz" * 50
    coded = [(long + b" ")[i : i + 64] for i in range(0, 151, 64)]
    alone = [prices.price([piece[:-1]])[0] for piece in coded if piece.endswith(b" ")]
    assert len(alone) == 1 and prices.price([long])[0] < alone[0]


def test_odd_rows_extra_columns_and_empty_tables(spark, tricky):
    texts = {(r.doc_id, r.text) for r in tricky.select("doc_id", "text").collect()}
    rows = lm.score(tricky, F.col("doc_id") != 8).collect()
    assert len(rows) == tricky.count()
    sizes = sorted(len(tokens(text)) for _, text in texts)
    assert sorted({r.n_tokens for r in rows}) == sorted(set(sizes))
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    untrained = lm.score(tricky, F.lit(False)).collect()
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in untrained)
    assert lm.score(tricky.limit(0), F.lit(True)).count() == 0


def sentences(spark):
    """Texts whose words follow each other always alike, some of them turned about, and copies held out."""
    rows = [(i, "the cat sat on the mat and the dog lay by the door") for i in range(40)]
    rows += [(100 + i, f"a word{i} of no weight stands here") for i in range(40)]
    rows += [(1000, rows[0][1]), (1001, "door dog the by and mat the lay sat the cat on the")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("tree_words", [1 << 16, 12])
def test_words_in_another_order_score_lower(spark, tree_words):
    rows = lm.score(sentences(spark), F.col("doc_id") < 1000, tree_words=tree_words).collect()
    scores = {r.key: r.score for r in rows}
    assert scores[1000] > scores[1001] + 3
    assert len(rows) == 82 and scores[0] == pytest.approx(scores[1000], rel=1e-9)


def test_scores_do_not_hang_on_what_is_joined(spark, documents):
    both = [
        {r.key: r.score for r in lm.score(documents, F.col("doc_id") % 7 != 2, tree_words=99, broadcast_words=n).collect()}
        for n in (1 << 18, 50)
    ]
    assert all(both[0][k] == pytest.approx(both[1][k], rel=1e-9) for k in both[0])


def plain_log2(model, leaves, hashed, kinds):
    """One word after another, one decision after another."""
    out = []
    for t, leaf in enumerate(leaves):
        total, first = 0.0, model.tree.first[leaf]
        for node, bit in zip(*(part[first : first + model.tree.depth[leaf]] for part in (model.tree.nodes, model.tree.bits))):
            spread = int(node) * 0xC2B2AE3D27D4EB4F
            seen = [
                int(table[((int(h[t]) ^ spread % 2**64) * 0x165667B19E3779F9 % 2**64) >> (64 - sequence.BITS)])
                for table, h in zip(model.slots, hashed)
            ]
            weight = model.weights[(seen[0] & 3) * 4 + (seen[1] & 3)].astype(float)
            inputs = [model.odds[node, kinds[t]], *((value >> 2) / 512 for value in seen), 0.3]
            odds = max(-12.0, min(12.0, float(weight @ np.array(inputs, float))))
            total -= math.log2(1 + math.exp(-odds if bit else odds))
        out.append(total)
    return np.array(out)


def test_sequences_equal_a_plain_coder_and_sum_to_one():
    rng = np.random.default_rng(4)
    masses = rng.integers(1, 50, (9, lm.CLASSES)).astype(float)
    tree = sequence.Tree.of(masses.sum(1))
    names, firsts = rng.integers(0, 9, 400), np.array([0, 150, 399])
    hashed, kinds = sequence.contexts(names, firsts), rng.integers(0, lm.CLASSES, 400)
    counts = sequence.empty()
    sequence.add(counts, tree, names, hashed)
    tables = [mixing.squeezed(t.reshape(-1, 2)) for t in counts]
    weights = sequence.learned(tables, tree, tree.odds(masses), [(names, hashed, kinds)])
    model = sequence.Model.of(tree, tree.odds(masses), tables, weights)
    found = model.price(names, hashed, kinds)
    assert found == pytest.approx(plain_log2(model, names, hashed, kinds), rel=1e-4)
    for t in (0, 1, 150, 399):
        same = [h[[t] * 9] for h in hashed]
        assert np.exp2(model.price(np.arange(9), same, kinds[[t] * 9])).sum() == pytest.approx(1, abs=1e-4)


def test_words_that_begin_alike_are_walked_once(monkeypatch):
    words = [b"counterrevolution" + b"%03d" % i for i in range(1000)] + [b"x\0", b"x", b"x\0\0", b"y" * 200]
    prices = small_model(words[:300], np.ones(300))
    alone = [prices.price([word])[0] for word in words]
    plain, lanes = mixing._bits, []
    monkeypatch.setattr(mixing, "_bits", lambda held, byte: (lanes.append(len(byte)), plain(held, byte))[1])
    assert prices.price(words) == pytest.approx(alone, rel=1e-6)
    # Beginnings, not the 21 bytes of every word: 17, then 10, 100, 1000 and as many ends.
    assert sum(lanes) < 2500


def test_cut_texts_equal_plain_words():
    texts = ["", None, " \t\n", "Ä b\x0bC  d e\x1cf ", "one", "\rTwo two\ftwo", "x" * 300]
    for most in (1, 20, 1 << 20):
        found = []
        for at, words in lm.cut_texts(pa.array(texts), most):
            assert at == len(found)
            for first, size in zip(words.firsts.tolist(), words.sizes.tolist()):
                found.append([words.spelled[i].decode() for i in words.numbers[first : first + size]])
        assert found == [tokens(text) for text in texts]


def numbered(spark):
    """More texts than any sample of 1,024, each of five words, one of them its own."""
    rows = [(i, f"the cat number{i} sat {'here' if i % 3 else 'there'}") for i in range(1300)]
    return spark.createDataFrame(rows, "doc_id long, text string"), [tokens(text) for _, text in rows]


def test_weights_are_fitted_to_every_decision_of_every_training_text(spark, monkeypatch):
    docs, texts = numbered(spark)
    plain, model, seen, trees = sequence.fitted, sequence.Model.of, [], []
    monkeypatch.setattr(sequence, "fitted", lambda counts, values: (seen.append(counts), plain(counts, values))[1])
    monkeypatch.setattr(sequence.Model, "of", lambda tree, *rest: (trees.append(tree), model(tree, *rest))[1])
    assert lm.score(docs, F.lit(True), sample_rows=20).count() == 1300
    counts = Counter(word for text in texts for word in text)
    order = sorted(counts, key=lambda word: (-counts[word], word.encode()))
    assert len(trees[0].depth) == len(order) + 1
    assert seen[0].sum() == sum(int(trees[0].depth[i]) * counts[word] for i, word in enumerate(order))


def test_classes_are_the_middles_of_all_training_texts(spark, monkeypatch):
    docs, texts = numbered(spark)
    plain, found = lm.Gate.moved, []
    monkeypatch.setattr(lm.Gate, "moved", lambda gate, sums: (found.append((gate, sums)), plain(gate, sums))[1])
    moved = lm._gate(lm._texts(docs, "doc_id", "text", F.col("doc_id") % 2 == 0), 20)
    (gate, sums), train = found[0], [" ".join(text) for text in texts[::2]]
    assert sums == pytest.approx(gate.sums(lm.Words.of(pa.array(train))))
    own = gate.of(lm.Words.of(pa.array(train)))
    for k in set(own.tolist()):
        assert moved.centers[:, k] == pytest.approx(sums[k] / np.linalg.norm(sums[k]), abs=1e-6)


def test_the_longest_context_holds_every_word(spark):
    words = [(f"w{i}".encode(), 1) for i in range(500)] + [(b"often", 7)]
    tables = lm._tables(spark.createDataFrame(words, "word binary, c long"), 200)
    bits = sum(8 * (len(word) + 1) * c for word, c in words)
    assert [int(table.sum(dtype=np.int64)) for table in tables] == [bits] * mixing.ORDERS


def test_the_mixer_learns_from_every_word_as_often_as_it_comes():
    words, counts = [b"w%d" % i for i in range(5000)], np.arange(1, 5001)
    tables = [mixing.squeezed(t) for t in mixing.counted(words, counts, np.ones(5000, bool))]
    mixer = mixing.learned(tables, words, counts, None, 1)
    bits = sum(8 * (len(word) + 1) * c for word, c in zip(words, counts.tolist()))
    assert (mixer.refine - mixing.Mixer.fresh().refine).sum() == pytest.approx(bits / 2)


def test_equally_frequent_words_are_taken_by_hash_and_not_left_out(spark):
    words = spark.range(1000).select(F.concat(F.lit("w"), "id").cast("binary").alias("word"), F.lit(10).alias("c"))
    words = words.unionByName(spark.createDataFrame([(b"top", 99)], "word binary, c int"))
    taken = {bytes(row.word) for row in words.filter(lm._frequent(words, 100)).collect()}
    assert b"top" in taken and 60 < len(taken) < 140
    assert words.filter(lm._frequent(words, 1001)).count() == 1001
    assert words.filter(lm._frequent(words, 0)).count() == 0


def test_lessons_leave_out_what_a_text_put_into_the_tables_itself():
    rng = np.random.default_rng(6)
    masses = rng.integers(1, 50, (7, lm.CLASSES)).astype(float)
    tree = sequence.Tree.of(masses.sum(1))
    names, firsts = rng.integers(0, 7, 300), np.array([0, 40, 41, 180])
    text = np.repeat(np.arange(4), np.diff(firsts, append=300))
    hashed, kinds = sequence.contexts(names, firsts), rng.integers(0, lm.CLASSES, 300)
    counts = sequence.empty()
    sequence.add(counts, tree, names, hashed)
    tables = [mixing.squeezed(t.reshape(-1, 2)) for t in counts]
    held = sequence.Lessons.of(tables, tree.odds(masses))
    found = sequence.lessons(held, tree, names, hashed, kinds, text)

    def ways():
        for t, leaf in enumerate(names):
            part = slice(tree.first[leaf], tree.first[leaf] + tree.depth[leaf])
            for node, bit in zip(tree.nodes[part].tolist(), tree.bits[part].tolist()):
                spread = node * 0xC2B2AE3D27D4EB4F % 2**64
                yield t, node, bit, [((int(h[t]) ^ spread) * 0x165667B19E3779F9 % 2**64) >> (64 - sequence.BITS) for h in hashed]

    own = Counter((text[t], i, slot, bit) for t, _, bit, slots in ways() for i, slot in enumerate(slots))
    wanted = Counter()
    for t, node, bit, slots in ways():
        cell = int(held.odds[node * lm.CLASSES + kinds[t]])
        for i, slot in enumerate(slots):
            left = [np.array([int(tables[i][slot, b]) - own[text[t], i, slot, b]]) for b in (0, 1)]
            cell = cell * sequence.SEEN + int(sequence._kinds(*left, sequence._LOG[left[1]] - sequence._LOG[left[0]])[0])
        wanted[cell * 2 + bit] += 1
    assert {int(i): int(found[i]) for i in np.flatnonzero(found)} == dict(wanted)


def test_fitted_weights_are_likelier_than_any_beside_them():
    rng = np.random.default_rng(8)
    values = [np.linspace(-6, 6, sequence.ODDS), np.linspace(-5, 5, sequence.SEEN), np.linspace(-5, 5, sequence.SEEN)]
    counts = np.zeros(sequence.CELLS, np.int64)
    cells = rng.integers(0, sequence.CELLS // 2, 4000)
    rest, two = np.divmod(cells, sequence.SEEN)
    odds, one = np.divmod(rest, sequence.SEEN)
    inputs = np.stack([values[0][odds], values[1][one], values[2][two], np.full(4000, 0.3)], 1)
    came = rng.random(4000) < 1 / (1 + np.exp(-inputs @ [0.7, 0.3, 0.2, 0.5]))
    np.add.at(counts, cells * 2 + came, 1)
    weights = sequence.fitted(counts, values).astype(float)
    gates = sequence._BUCKET_OF[one] * 4 + sequence._BUCKET_OF[two]

    def cost(w):
        mixed = np.einsum("ij,ij->i", inputs, w[gates])
        return np.logaddexp(0, np.where(came, -mixed, mixed)).sum() + 2 * ((w - sequence._start()) ** 2).sum()

    for step in rng.normal(0, 0.02, (20, *weights.shape)):
        assert cost(weights) < cost(weights + step)
    assert weights[15] == pytest.approx([0.7, 0.3, 0.2, 0.5], abs=0.25)
