import pytest
from pyspark.sql import functions as F

from clickloom.llm import quality

PROSE = "This is a plain sentence of ten words or so, indeed. "


def judged(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(quality.judge(docs).collect(), key=lambda r: r.doc_id)


@pytest.mark.parametrize(
    "line, bad",
    [
        (PROSE, False),
        ("wo### rd*** so&&& me$$$ ju%%% nk###", True),
        ("BUY!! NOW!! CHEAP!! THINGS!! HERE!!", True),
        ("Home | About | Contact us | Terms | Imprint", True),
        ("Contact us", True),
        ("The end.", False),
        ("« Oui ! »", True),
        ("All Rights Reserved, the company, in the year of the lord.", True),
        ("He said that all rights reserved to kings were void. " + "And so on it went. " * 12, False),
        ("", False),
        (" \t", False),
        ("Licensed under the Apache License, Version 2.0.", False),
    ],
)
def test_rules_of_lines(spark, line, bad):
    frame = spark.createDataFrame([(line,)], "line string")
    assert frame.select(quality.bad_line(F.col("line"))).first()[0] is bad


def brute_repeats(words):
    found = {}
    for i in range(len(words) - 7):
        found.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({p for at in found.values() if len(at) > 1 for i in at for p in range(i, i + 8)})


def test_base_figures(spark):
    texts = [
        "a b c d e f g h " * 3,
        "x " * 9,
        "x " * 8,
        "a b c d e f g h i. a b c d e f g h j " + "z y x w v u t s r " * 2,
        " ".join(f"w{i}" for i in range(500)),
        "one #$ two\none #$ two\n\n \n\none #$ two\nfoo|<",
    ]
    for row, text in zip(judged(spark, *texts), texts):
        words = text.split()
        assert row.n_words == len(words)
        assert row.word_chars == sum(map(len, words))
        assert row.n_repeat_words == brute_repeats(words)
        assert row.n_symbols == sum(c in "#*$%&|<>" for c in text)
        real = [x for x in text.split("\n") if x.strip()]
        assert row.n_dup_lines == len(real) - len(set(real))
        assert row.base_failed == (len(words) < 20 or 100 * brute_repeats(words) > 30 * len(words))


def test_documents_that_lose_too_much_go(spark):
    good = " ".join(f"Sentence {i} is plain and says word{i} to all." for i in range(9))
    junk = "ju### nk*** ju$$$ nk%%% " * 20
    rows = judged(spark, good, good + "\n" + junk[:60], junk + "\n" + good[:100], junk)
    assert [r.kept for r in rows] == [True, True, False, False]
    assert rows[1].clean_text == good and rows[1].n_bad_lines == 1


def test_odd_rows_extra_columns_and_empty_tables(spark, tricky):
    rows = quality.judge(tricky)
    rest = [c for c in tricky.columns if c not in quality.ADDED]
    assert rows.columns == [*rest, *quality.ADDED]
    found = {(r.doc_id, r.n_words, r.kept) for r in rows.collect()}
    assert {(1, 0, False), (2, 0, False), (4, 0, False), (9, 0, False), (6, 1, False)} <= found
    assert quality.judge(tricky.limit(0)).count() == 0
    kept = quality.clean(tricky)
    assert kept.columns == tricky.columns
    wanted = sorted(str(r.doc_id) for r in rows.filter("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == wanted


def test_labels_agree(spark, sf_dir, documents):
    """Clean documents stay, but for those that the base rules reject; most of the rest go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.judge(documents).join(labels, "doc_id").collect()
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1)
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(bad) <= 0.1 * len(bad)


def test_no_python_in_the_plan(documents):
    plan = quality.judge(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_a_million_spaces_take_seconds(spark):
    import time

    docs = spark.range(1).select(
        F.lit(1).alias("doc_id"), F.expr("concat('a b', repeat(' ', 1000000), 'c', repeat('\t', 1000000))").alias("text")
    )
    started = time.perf_counter()
    assert quality.judge(docs).select("n_words").first().n_words == 3
    assert time.perf_counter() - started < 20
