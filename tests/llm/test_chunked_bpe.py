import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from clickloom.llm import chunked_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    with open(RANKS, "rb") as lines:
        held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens={}
    )


def row_of(model, key, text):
    """What the library says of a whole text."""
    ids = model.encode_ordinary(text or "")
    assert model.decode_bytes(ids) == (text or "").encode()
    shown = ",".join(map(str, ids)).encode()
    return (
        key,
        len(ids),
        hashlib.sha256(shown).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


def found(docs, **sizes):
    whole, parts = chunked_bpe.encode(docs, RANKS, **sizes)
    return sorted(map(tuple, chunked_bpe.digests(whole, parts, RANKS).collect()), key=repr)


def test_the_query_against_the_library(spark, sf_dir, model, documents):
    rows = queries.QUERIES["op13_byte_bpe"](spark, sf_dir)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    expected = [row_of(model, r.doc_id, r.text) for r in documents.collect()]
    assert sorted(map(tuple, rows.collect())) == sorted(expected)


@pytest.mark.parametrize("chunk, overlap", [(5, 4), (16, 7), (64, 32)])
def test_chunks_of_any_size_give_the_whole_text(spark, model, chunk, overlap):
    chance = random.Random(chunk)
    units = "ab Z9'\n\t .,!é中😀  \x1c_ͅ٣½𝟘𐐀"
    words = ["'ll", "'re", " 've", "we'd", "   ", "\r\n\r\n", "1234567", "word", " word", "!!'s"]
    texts = [
        "".join(chance.choice(words if chance.random() < 0.4 else units) for _ in range(n))
        for n in [0, 1, 4, 15, 16, 17, 33, 100, 100, 100, 400]
    ]
    # Stretches without a boundary for many chunks, at the start, inside and at the end.
    run = "x" * (9 * chunk)
    texts += [run, run + " a b", "a b " + run, "a " + run + " b " + run[:-1], " " * 7 * chunk + "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = [row_of(model, i, text) for i, text in enumerate(texts)]
    assert found(docs, chunk_chars=chunk, overlap=overlap) == sorted(expected, key=repr)


def test_classes_are_the_librarys_for_all_characters(model):
    coder = chunked_bpe.Coder.open(RANKS, public_tokenizers.PATTERN)
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    for text in ("".join(every), " ".join(every), "a".join(every)):
        assert "".join(coder.pieces(text)) == text
        ids = [i for p in coder.pieces(text) for i in model._encode_single_piece(p)]
        assert ids == model.encode_ordinary(text)


def test_odd_rows(spark, model, tricky):
    expected = [row_of(model, r.doc_id, r.text) for r in tricky.select("doc_id", "text").collect()]
    assert found(tricky, chunk_chars=4096, overlap=64) == sorted(expected, key=repr)
    assert found(tricky.limit(0)) == []


def test_sizes_are_checked(documents):
    with pytest.raises(ValueError):
        chunked_bpe.encode(documents, RANKS, chunk_chars=8, overlap=8)
    with pytest.raises(ValueError):
        chunked_bpe.encode(documents, RANKS, overlap=3)
