"""Byte-pair ids by the tokenizers library, each distinct word encoded once for many uses."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402  (reads the variable above)


# The public splitting rule of byte-level vocabularies, here for ASCII and Latin
# letters alone, and the letters that stand for bytes in their files.
PARTS = re.compile(
    r"\n|'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+| ?[0-9]+"
    r"| ?[^\sA-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f0-9]+"
)
PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
_SAME = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: chr(b) for b in _SAME} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SAME)
}
_LETTERS = {b: letter for b, letter in SHOWN.items() if b != 10}
#: Stands between lines: no id of any vocabulary.
_END = 0xFFFFFFFF
#: Pieces that are remembered, if nothing else is said.
ROOM = 1_000_000
_BREAK = {"\n": struct.pack("<I", _END)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    A byte-level vocabulary with the usual splitting rule never merges across a space or a line
    break that stands between two characters that are no white space: what follows is then
    encoded by itself. So texts are cut there, by Arrow and some megabytes at a time, and each
    distinct piece is encoded once, as long as about ``room`` of them are remembered. New pieces of ASCII and Latin letters are split together,
    and the library's model merges each run of letters, digits or signs; others go to the library
    as they are. A text with another run of white space, or with the text of a special token, goes
    there whole. Either way the ids are the library's for the whole text.
    """

    #: Bytes of texts that are cut together, and whose new pieces are learned together.
    BYTES = 1 << 22

    _open: dict[tuple[str, int], "Encoder"] = {}

    def __init__(self, path: str, room: int = ROOM):
        self.tokenizer = Tokenizer.from_file(path)
        self.room = room
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.pieces: dict[str, bytes | bool] = {}
        self.parts: dict[str, bytes] = dict(_BREAK)
        self.line = self._whole("\n")
        # The cut needs a line break that is one id and stays one between pieces, and the split a
        # vocabulary with the usual rule.
        self.cut = len(self.line) == 4 and self._whole(" a\n b\nc d") == self.line.join(
            [self._whole(" a"), self._whole(" b"), self._whole("c") + self._whole(" d")]
        )
        probe = " It's", "a1b,", " zwei\xdf", " .d\u00e9j\u00e0-vu", "we'll", " 'tis", " #!x_y", "12ab"
        self.plain = self.cut and self._lines("\n".join(probe)) == [*map(self._whole, probe)]

    @classmethod
    def open(cls, path: str, room: int = ROOM) -> "Encoder":
        """One encoder for each vocabulary and worker, so that pieces serve all its tasks."""
        if (path, room) not in cls._open:
            cls._open[path, room] = cls(path, room)
        return cls._open[path, room]

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        return list(self.column(pa.array(texts, pa.large_string())))

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of a column's texts, some megabytes of text at a time."""
        start, held = 0, 0
        for at, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if held and held + size > self.BYTES:
                yield from self._some(texts.slice(start, at - start))
                start, held = at, 0
            held += size
        if start < len(texts):
            yield from self._some(texts.slice(start))

    def _some(self, texts: pa.Array) -> Iterator[bytes]:
        """Arrow cuts the texts and numbers their pieces; Python sees each distinct one once."""
        texts = pc.fill_null(texts, "")
        if not self.cut:
            yield from map(self._whole, texts.to_pylist())
            return
        if len(self.pieces) > self.room:
            self.pieces.clear()
        # Each piece has the line break before it, and one is put before the first, which has no space there.
        spaced = pc.replace_substring(texts, "\n", " \n")
        first, nothing = (pa.scalar(value, texts.type) for value in ("\n", ""))
        split = pc.split_pattern(pc.binary_join_element_wise(first, spaced, nothing), " ")
        coded = split.flatten().dictionary_encode()
        # No piece has a space in it. One long string becomes many faster than an array does.
        pieces = coded.dictionary.cast(pa.string())
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), " ")
        distinct = joined[0].as_py().split(" ")
        found = list(map(self.pieces.get, distinct))
        new = [i for i, ids in enumerate(found) if ids is None]
        self._learn([distinct[i] for i in new])
        for i in new:
            found[i] = self.pieces[distinct[i]]
        tied = np.fromiter((ids is False for ids in found), bool, len(found))
        found = [ids or b"" for ids in found]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        number = coded.indices.to_numpy()
        # All ids of all texts, and where each text's begin.
        size = sizes[number]
        ends = np.cumsum(size)
        where = np.repeat(starts[number] - ends + size, size) + np.arange(size.sum())
        raw = np.frombuffer(b"".join(found), "<u4")[where].tobytes()
        bounds = split.offsets.to_numpy()
        cuts = (4 * np.concatenate([[0], ends])[bounds]).tolist()
        whole = np.logical_or.reduceat(tied[number], bounds[:-1])
        for mark in self.special:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        for i, (low, high, apart) in enumerate(zip(cuts, cuts[1:], whole.tolist())):
            yield self._whole(texts[i].as_py()) if apart else raw[low + 4 : high]

    def _learn(self, pieces: list[str]) -> None:
        """The ids of new pieces; False for one that white space ties to the piece before."""
        first: list[str] = []
        inner: list[str] = []
        for piece in pieces:
            starts = piece[:1] == "\n"
            if self.plain and PLAIN.fullmatch(piece, starts):
                (first if starts else inner).append(piece)
                continue
            word = piece[1:] if starts else piece
            if not word or word[0].isspace():
                self.pieces[piece] = False
            else:
                self.pieces[piece] = self._whole(piece if starts else " " + word)
        if first:
            lines = self._lines("".join(first)[1:])
            self.pieces.update(zip(first, map(self.line.__add__, lines)))
        if inner:
            self.pieces.update(zip(inner, self._lines(" " + "\n ".join(inner))))

    def _lines(self, lines: str) -> list[bytes]:
        """The ids of plain pieces with line breaks between them, split and merged together."""
        if len(self.parts) > self.room // 2:
            self.parts = dict(_BREAK)
        parts = PARTS.findall(lines + "\n")
        new = list(set(parts).difference(self.parts))
        letters = "\n".join(new).encode().decode("latin-1").translate(_LETTERS).split("\n")
        flat: list[int] = []
        ends = [0]
        for spelled in letters if new else ():
            flat += [token.id for token in self.merge(spelled)]
            ends.append(4 * len(flat))
        raw = np.array(flat, "<u4").tobytes()
        self.parts.update(zip(new, [raw[low:high] for low, high in zip(ends, ends[1:])]))
        raw = b"".join(map(self.parts.__getitem__, parts))
        ends = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == _END)).tolist()
        return [raw[low:high] for low, high in zip([0, *(end + 4 for end in ends)], ends)]
