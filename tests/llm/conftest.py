import pytest

#: Names that operators use inside, as columns of the documents.
CLASHES = (
    "key word found n_lines n_dropped kept clean_text point row group train content shard c p0 host"
    " path bad licence lines words score sentences chunk kind first"
).split()


@pytest.fixture(scope="session")
def tricky(spark):
    """Null, empty, blank, equal, very long and repeated texts, null and repeated ids, and columns
    whose names operators use themselves; keyed by what the rows are for."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, None),
        (2, ""),
        (3, "one two three four\nfive"),
        (3, "one two three four\nfive"),
        (4, " \t\n\r \x0b\x0c\n"),
        (5, long),
        (6, "x" * 100_000),
        (None, "a text without a number\nand a second line"),
        (8, "Ünïcödé 日本語 words é è 😀 and more"),
        (9, "\n\n\n"),
        (None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{name}` string" for name in CLASHES
    )
    full = [(i, t, None, "s", None, *(["c"] * len(CLASHES))) for i, t in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """The texts of the small documents table by id, in Python."""
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
