import random

import pytest
from pyspark.sql import functions as F

from clickloom.llm import spelling


def one_apart(a, b):
    """By the full table of edit distances."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            rows[i].append(best)
    return rows[-1][-1] == 1


def grouped(words, ratio):
    """The whole answer from all pairs."""
    near = {w: [o for o in words if abs(len(o) - len(w)) < 2 and one_apart(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(
        (w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words
    )


def drawn(seed, letters, count, longest):
    chance = random.Random(seed)
    words = {}
    while len(words) < count:
        word = "".join(chance.choice(letters) for _ in range(chance.randrange(1, longest)))
        for _ in range(chance.randrange(4)):
            words[word] = 10 ** chance.randrange(5) + chance.randrange(3)
            at = chance.randrange(len(word))
            word = word[:at] + chance.choice(["", *letters]) + word[at + chance.randrange(2) :]
            if not word:
                break
    return words


def table_of(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize(
    "letters, count, longest, block, ratio",
    [
        ("ab", 150, 9, 1 << 14, 10),
        ("abcdefghijklmnopqrstuvwxyzàéöÿ", 400, 9, 1 << 14, 10),
        ("abcde", 300, 7, 16, 2),
        ("aáâ😀", 200, 6, 8, 1),
    ],
)
def test_against_all_pairs(spark, letters, count, longest, block, ratio):
    words = drawn(count, letters, count, longest)
    if ratio < 2:
        # Equal counts would lead in circles; the ratio is what keeps forms apart.
        words = {w: n * 7 + i for i, (w, n) in enumerate(words.items())}
    ratio = max(ratio, 2)
    found = spelling.group(table_of(spark, words), ratio, block)
    assert sorted(map(tuple, found.collect())) == grouped(words, ratio)


def test_one_vector_for_all_words(spark):
    """Anagrams only: no level of the trie parts them, halves do."""
    chance = random.Random(3)
    words = {"".join(chance.sample("aaabbbcd", 8)): chance.randrange(1, 9999) for _ in range(400)}
    words |= {w[:-1]: n for w, n in list(words.items())[::7]}
    found = spelling.group(table_of(spark, words), 10, 64)
    assert sorted(map(tuple, found.collect())) == grouped(words, 10)


def test_long_words(spark):
    words = {"x" * 64: 1, "x" * 65: 20, "x" * 66: 300, "x" * 3000: 5, "x" * 2999 + "y": 90, "xy" * 32: 2}
    found = spelling.group(table_of(spark, words), 10)
    assert sorted(map(tuple, found.collect())) == grouped(words, 10)


def test_a_chain_of_forms_is_followed_to_its_end(spark):
    words = {"a" * (20 - i) + "b" * i: 10**i for i in range(12)}
    found = {r.word: r.root for r in spelling.group(table_of(spark, words), 10).collect()}
    assert set(found.values()) == {"a" * 9 + "b" * 11}


def test_runs_are_whole_and_lower_only_ascii(spark, tricky):
    rows = [(1, "ABCdefg, abc ÀÉabcd×e ÷ abcdefĀgh xabcdefg1hijklmn"), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spelling.runs(docs, "A-Za-zÀ-ÿ", 7).collect()
    assert sorted(r.word for r in found) == ["abcdefg", "hijklmn", "xabcdefg", "ÀÉabcd×e"]
    assert spelling.runs(tricky, "A-Za-z", 7).where("word IS NULL").isEmpty()
    cut = spark.createDataFrame([("wörter", 0), ("wörter", 1), ("wörter", 5)], "word string, i int")
    left = cut.select(spelling.without(F.col("word"), F.col("i"))).collect()
    assert [r[0] for r in left] == ["örter", "wrter", "wörte"]


def test_odd_words(spark):
    rows = [(None, 4), ("same", 1), ("same", 2), ("sane", 40), ("", 1), ("q", 1)]
    words = spark.createDataFrame(rows, "word string, n long")
    found = sorted(map(tuple, spelling.group(words, 10).collect()))
    assert found == grouped({"same": 3, "sane": 40, "": 1, "q": 1}, 10)
    assert spelling.group(words.limit(0)).count() == 0
