"""Token files and packing, against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clickloom.llm import packing, token_files
from clickloom.llm.bpe import Encoder
from clickloom.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text, end):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


ODD = st.text(
    st.sampled_from(list("aB1é日😀.,!'s_-") + [" ", " ", "\n", "\t", "\r", "\xa0", "　", "\x1c", "\x85"])
)


@settings(max_examples=300, deadline=None)
@given(st.one_of(ODD, st.text()))
def test_pieces_give_the_ids_of_the_whole(text):
    encoder = Encoder.open(PATH)
    assert encoder.plain and encoder.cut
    assert encoder.encode([text])[0] == ids_of(text, 0)[:-1].tobytes()


def test_special_tokens_and_forgetting():
    encoder = Encoder(PATH, room=3)
    texts = ["<|endoftext|> a b", "it's we'll 12ab zweiß!", " lead", "trail ", "a  b", None, ""]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids == ids_of(text, 0)[:-1].tobytes()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_packed_bits_come_back(width, ids):
    ids = np.array(ids, "<u4") & np.uint32((1 << width) - 1)
    content = token_files.packed(ids, width)
    assert len(content) == -(-len(ids) * width // 8)
    assert (token_files.unpacked(content, len(ids), width) == ids).all()


def test_a_file_gives_any_range_of_ids():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5000, n).astype("<u4") for n in (0, 1, 700, 64, 3000)]
    for width, block in ((13, 64), (16, 100), (20, 4096)):
        content = token_files.file_bytes(2, 3, [5, None, -7, 8, 9], docs, width, block)
        held = token_files.TokenFile(content + b"\n")
        assert (held.part, held.shard, held.keys) == (2, 3, [5, None, -7, 8, 9])
        assert all((held.document(i) == doc).all() for i, doc in enumerate(docs))
        whole = np.concatenate(docs)
        for start, end in ((0, 0), (5, 6), (60, 70), (0, len(whole)), (700, 2900)):
            assert (held.ids(start, end) == whole[start:end]).all()


def files_of(spark, docs, **options):
    path = scratch_path(spark, "tokens")
    token_files.write(docs, path, PATH, end_id=2, **options)
    rows = token_files.read(spark, path).selectExpr("*", "length(ids) div 4 as n_tokens")
    return token_files.with_starts(rows)


@pytest.mark.parametrize("file_ids", [1 << 20, 300])
def test_files_hold_all_documents_in_order(spark, documents, texts, file_ids):
    rows = files_of(spark, documents, file_ids=file_ids, block_ids=64).collect()
    start = 0
    for row, key in zip(sorted(rows, key=lambda r: r.key), sorted(texts), strict=True):
        ids = ids_of(texts[key], 2)
        assert (row.key, row.start, row.n_tokens) == (key, start, len(ids))
        assert bytes(row.ids) == ids.tobytes()
        start += len(ids)


def test_files_of_odd_rows_and_of_none(spark, tricky):
    rows = files_of(spark, tricky).collect()
    texts = [(r.doc_id, r.text) for r in tricky.select("doc_id", "text").collect()]
    assert sorted(bytes(r.ids) for r in rows) == sorted(ids_of(t, 2).tobytes() for _, t in texts)
    rows.sort(key=lambda r: r.start)
    assert [r.key for r in rows] == [None, None, 1, 2, 3, 3, 4, 5, 6, 8, 9]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert files_of(spark, tricky.limit(0)).count() == 0


def checked(rows, texts, length):
    """Pieces are the ids of their documents; sequences have no gap and no overflow."""
    by_doc, by_sequence = {}, {}
    for row in rows:
        by_doc.setdefault(row.key, []).append(row)
        by_sequence.setdefault(row.sequence_id, []).append(row)
    for key, text in texts.items():
        ids, start = ids_of(text, 0), 0
        pieces = sorted(by_doc[key], key=lambda r: r.piece)
        for number, row in enumerate(pieces):
            assert (row.piece, row.start) == (number, start) and 0 < row.length <= length
            assert number == 0 or row.length == length
            assert row.ids_crc32 == zlib.crc32(ids[start : start + row.length].tobytes())
            start += row.length
        assert start == len(ids) and (len(ids) > length or len(pieces) == 1)
    for parts in by_sequence.values():
        at = 0
        for row in sorted(parts, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= length
    return len(by_sequence)


def test_packing_is_valid_and_close_to_the_bound(spark, documents, texts):
    rows = packing.pack(documents, PATH, end_id=0, length=512).collect()
    total = sum(len(ids_of(t, 0)) for t in texts.values())
    assert checked(rows, texts, 512) <= 1.02 * total / 512 + 2
    few = packing.pack(documents, PATH, end_id=0, length=512, open_bins=2, group_rows=20).collect()
    checked(few, texts, 512)


def test_sequences_hold_the_ids(spark, documents, texts):
    placed = packing.pack(documents, PATH, end_id=0, length=256, with_ids=True)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(placed).collect()}
    for row in placed.collect():
        part = whole[row.sequence_id][4 * row.offset : 4 * (row.offset + row.length)]
        assert part == bytes(row.ids)


def test_best_fit_and_closing_of_the_fullest():
    bins = packing.Bins(10, most_open=2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # the tighter of two fits, which fills it
    assert bins.place(5) == (2, 0)
    assert bins.place(8) == (3, 0)  # closes the fullest, which is bin 0
    assert bins.place(4) == (2, 5)
    rng = random.Random(3)
    bins, used = packing.Bins(100, most_open=7), {}
    for _ in range(5000):
        size = rng.randint(1, 100)
        number, offset = bins.place(size)
        assert used.get(number, 0) == offset and offset + size <= 100
        used[number] = offset + size
        assert bins.open <= 7


def test_packing_of_odd_rows_and_of_none(spark, tricky):
    rows = packing.pack(tricky, PATH, length=128).collect()
    texts = [r.text for r in tricky.select("text").collect()]
    assert sum(r.length for r in rows) == sum(len(ids_of(t, 0)) for t in texts)
    assert sum(r.piece == 0 for r in rows) == len(texts)
    assert packing.pack(tricky.limit(0), PATH).count() == 0


def test_ids_are_the_librarys_whatever_stands_between_two_letters():
    """Every character below the last one that is split here, and some above, in many places."""
    encoder = Encoder(PATH)
    assert encoder.cut and encoder.plain
    characters = [chr(c) for c in range(0x300)] + list("ͅ؀٣　中​😀  ")
    forms = ["a{}b", " {}", "{} a", "a {}{} b", "'{}", "1{}2 {}", "a\n{}", "{}\n{}b", "it's{}'ll {}'re", ".{}!"]
    texts = [" x ".join(form.replace("{}", c) for form in forms) for c in characters]
    expected = [np.array(TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == expected
    # Pieces that are forgotten are learned again.
    small = Encoder(PATH, room=3)
    assert small.encode(texts) == expected


class Asked(dict):
    """A dictionary that counts how often it is asked."""

    times = 0

    def get(self, *args):
        self.times += 1
        return super().get(*args)

    def __getitem__(self, key):
        self.times += 1
        return super().__getitem__(key)


def test_repeated_pieces_are_looked_up_once():
    encoder = Encoder(PATH)
    encoder.pieces = asked = Asked(encoder.pieces)
    texts = ["one two three\nfour " * 500 + str(i) for i in range(20)]
    expected = [ids_of(t, 0)[:-1].tobytes() for t in texts]
    assert encoder.encode(texts) == expected
    # Every piece is asked for, and once more if it is new.
    assert asked.times < 100


@pytest.mark.parametrize("size", [1, 40, 1 << 22])
def test_texts_taken_a_few_at_a_time(monkeypatch, size):
    monkeypatch.setattr(Encoder, "BYTES", size)
    texts = [None, "", "a b\nc", "  two  spaces", "x" * 100, None, "<|endoftext|> z", "déjà\tvu", "\n", ""]
    expected = [ids_of(t, 0)[:-1].tobytes() for t in texts]
    assert Encoder(PATH).encode(texts) == expected
