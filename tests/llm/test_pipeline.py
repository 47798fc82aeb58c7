import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from clickloom.llm import quality


def test_stages_are_in_order():
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    assert pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    """Clean prose with, among it, copies, a benchmark passage, a shared line and junk."""
    rng_words = [f"word{i}" for i in range(900)]

    def prose(seed, count=120):
        words = [rng_words[(seed * 7919 + i * 104729 + i * i * seed) % 900] for i in range(count)]
        return " ".join(words) + "."

    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    docs = [(i, prose(i + 1)) for i in range(40)]
    docs += [(100 + i, prose(i + 1)) for i in range(5)]
    docs += [(110 + i, prose(i + 1).replace("word1 ", "other ") + " End.") for i in range(5)]
    docs += [(200, prose(60) + "\n" + item)]
    docs += [(300 + i, "The same old line in all of these.\n" + prose(70 + i)) for i in range(12)]
    docs += [(400, "ju### nk*** " * 40), (401, "too short")]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )


def test_each_stage_does_its_part(spark, sf_dir, planted):
    kept, seen = planted, {}
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == planted.columns
        seen[name] = {r.doc_id: r for r in kept.collect()}
    clean = set(range(40))
    assert {400, 401}.isdisjoint(seen["quality"]) and clean <= set(seen["quality"])
    assert {200, *range(300, 312)} <= set(seen["quality"])
    lines = seen["line_dedup"]
    assert all("same old line" not in lines[300 + i].text for i in range(12))
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert set(seen["near_dedup"]) == set(lines) - set(range(100, 115))
    assert set(seen["decontaminate"]) == set(seen["near_dedup"]) - {200}
    pieces = pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(seen["decontaminate"])


def test_the_run_over_the_table(spark, sf_dir, documents):
    kept = documents
    for _, stage in pipeline.STAGES:
        kept = stage(spark, kept, sf_dir).cache()
    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ours = pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, ours.select(*order).collect())) == sorted(
        map(tuple, kept.select(*order).collect())
    )
    rejected = quality.judge(documents).filter(~F.col("kept")).select("doc_id")
    assert ours.join(rejected, "doc_id").count() == 0


def test_odd_rows_extra_columns_and_empty_tables(spark, sf_dir, tricky):
    for name, stage in pipeline.STAGES:
        for docs in (tricky, tricky.limit(0), tricky.select("doc_id", "text")):
            found = stage(spark, docs, sf_dir)
            if name != "pack":
                assert found.columns == docs.columns
                others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
                assert others == [] or {tuple(r) for r in found.select(*others).collect()} <= {
                    tuple(r) for r in docs.select(*others).collect()
                }
            assert found.count() <= max(1, 2000 * docs.count())


def test_equal_words_in_five_orders_are_five_documents(spark, sf_dir):
    import random

    words = [f"word{i}" for i in range(200)]
    docs = [(i, " ".join(random.Random(i % 5).sample(words, 200))) for i in range(15)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = pipeline.near_dedup_stage(spark, frame, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4]
