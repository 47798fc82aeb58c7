"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each a function of (spark, docs, sf_dir); ``docs`` are the rows that the stage before
kept, with the columns of the documents table. Every stage but the last returns those columns.

1. ``quality``: documents that the quality rules reject go; the others lose their failing lines.
2. ``line_dedup``: lines found in ten documents or more go from every document.
3. ``near_dedup``: one document of each group of near copies stays, the one with the least id.
4. ``decontaminate``: documents that hold a ten-word window of a benchmark item go.
5. ``pack``: what is left becomes sequences of at most 2048 ids, a row for each piece.

``n_chars`` follows the text where a stage changes it. Between stages the rows are written as Parquet
below the shared folder and read again, so that a lost executor repeats a stage at most.

Defined cases: a null, empty or blank text has no words and goes in the first stage; texts of any
length are taken whole; rows that share an id, or have none, are documents of their own, and of equal
rows one stays after the third stage; ties there go to the least id, then the least digest of the
text; an empty table gives empty tables. Columns beside doc_id and text are carried on, whatever
their names, or may be missing; only n_chars is changed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import decontaminate as contamination
from clickloom.llm import packing, quality, simhash
from clickloom.llm.line_dedup import LineIndex
from clickloom.session import stored


#: Near copies: fingerprints of the distinct words, six words of 64 bits, and a sketch of the
#: five-word shingles in 128 parts. A pair is found if any word differs in at most 3 bits, and is one
#: if all 384 differ in at most 32 and no more than 34 parts: those of texts alike by 0.8 differ in 24,
#: give or take 4.4, and of texts alike by 0.6 in 48.
NEAR = {
    "shingle": 1,
    "distinct": True,
    "words": 6,
    "radius": 3,
    "most": 32,
    "sketched": (5, 8),
    "differing": 34,
}


#: Pieces of text whose ids a worker of the last stage remembers.
ROOM = 100_000


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as named, with n_chars (if there) of the text as it is now."""
    if "n_chars" in columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        docs = docs.withColumn("n_chars", size)
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return _recounted(quality.clean(docs), docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them or more share."""
    index = LineIndex.build(docs.select("text"), threshold=10, min_chars=1)
    # Names that the operator's own columns do not have.
    names = [c if c == "text" else f"__c{i}" for i, c in enumerate(docs.columns)]
    stripped = index.strip(docs.toDF(*names)).select(*names).toDF(*docs.columns)
    return _recounted(stripped, docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs, **NEAR)


def _small_batches(spark: SparkSession) -> None:
    """Fewer texts at a time between Spark and Python. The last stages run in workers that keep the
    memory of those before; their rows are independent of the batch they come in."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.clean(docs, benchmark, window=10)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences."""
    _small_batches(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    placed = packing.pack(docs, vocabulary, end_id=0, length=2048, room=ROOM)
    return placed.withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

#: SQL has neither the 64-bit hash of the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
