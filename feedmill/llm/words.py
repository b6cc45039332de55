"""Texts cut at spaces, and what is worked out once for each different part [helper of op11 and op12].

A space after a character that is no white space always begins a pre-token of the byte-level pattern, and no
piece of a vocabulary that marks word starts with spaces crosses it.  So a text may be cut there and its parts encoded one
by one: the ids are those of the whole text.

Where only the byte-level pattern counts, ``pieces_of`` cuts finer: a line end after what is no white space and a mark after a
letter or digit begin a pre-token too, so a word is one piece whatever stands behind it.  No cut follows white space, where
the pattern looks ahead.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of parts and results that a task remembers; the memory is cleared when it is full.
REMEMBERED_BYTES = 192 << 20
#: Parts that are encoded in one call.
CALL_PARTS = 1 << 14
#: Parts that the byte-level tokenizer sees as one text.
RUN_PARTS = 256

#: No part but that of an empty text is empty: some tokenizers add their space only to what is not.
_SPACE = re.compile(r"(?<=\S) (?!\Z)")
_WIDE = re.compile(r"\s ")


def parts_of(text: str) -> list[str]:
    """The parts of a text; joined by one space each they give the text again."""
    if text[:1] == " " or text[-1:] == " " or _WIDE.search(text):
        return _SPACE.split(text)
    return text.split(" ")  # every space is one to cut at


#: Kinds of bytes: a space or line end, other ASCII white space, an ASCII mark, other ASCII, an ASCII letter or digit, not ASCII.
_GAP, _WHITE, _MARK, _OTHER, _WORD, _HIGH = range(6)
_KIND = np.array([
    _HIGH if b > 0x7F else _GAP if chr(b) in " \n" else _WHITE if chr(b).isspace() else _WORD if chr(b).isalnum()
    else _MARK if 0x20 < b < 0x7F else _OTHER for b in range(256)
], np.uint8)


def _codes(chars: Iterable[str]) -> np.ndarray:
    return np.array([int.from_bytes(c.encode(), "big") for c in chars])


#: UTF-8 bytes of the white space that is not ASCII, and of the letters of Latin-1, Latin Extended-A and Cyrillic.
_WIDE_SPACES = _codes(c for c in map(chr, range(0x80, 0x10000)) if c.isspace())
_LETTERS = _codes(c for c in map(chr, [*range(0xC0, 0x180), *range(0x400, 0x482)]) if c.isalpha())


def _follow(data: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether one of these characters of two or three bytes ends before each place; the bytes before the places are not ASCII."""
    two = data[at - 2].astype(np.int64) << 8 | data[at - 1]
    three = data[np.maximum(at - 3, 0)].astype(np.int64) << 16 | two
    return np.isin(two, codes) | np.isin(three, codes)


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts (valid UTF-8 without nulls) one after another, and how many there are up to the end of each text."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    kind = _KIND[data]
    before, at = kind[:-1], kind[1:]
    begins = np.zeros(len(data), bool)
    for found, codes, ends in (
        (np.flatnonzero((at == _GAP) & (before > _WHITE)) + 1, _WIDE_SPACES, False),
        (np.flatnonzero((at == _MARK) & (before > _OTHER)) + 1, _LETTERS, True),
    ):
        wide = kind[found - 1] == _HIGH
        begins[found[~wide]] = True
        wide = found[wide]
        begins[wide[_follow(data, wide, codes) == ends]] = True
    begins[edges[:-1][edges[:-1] < edges[1:]]] = True
    starts = np.flatnonzero(begins)
    offsets = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    return pieces, np.searchsorted(starts, edges[1:])


class Remembered(dict):
    """Results by part.  ``make`` works out the results of many new parts at once."""

    def __init__(self, make: Callable[[list[str]], list], weight: Callable[[object], int] = len, limit: int = REMEMBERED_BYTES):
        super().__init__()
        self.make, self.weight, self.limit, self.held = make, weight, limit, 0

    def learn(self, parts: Iterable[str]) -> None:
        """Make sure that every part of a block is known; the block itself is of bounded size."""
        wanted = set(parts)
        new = [p for p in wanted if p not in self]
        if new and self.held > self.limit:
            self.clear()
            self.held, new = 0, list(wanted)
        self._add(new)

    def results(self, parts: list[str]) -> list:
        """The results of all parts of a block, in their order; known parts are looked up once."""
        if self.held > self.limit:
            self.clear()
            self.held = 0
        found = list(map(self.get, parts))
        new = {p for p, r in zip(parts, found) if r is None}
        if new:
            self._add(list(new))
            found = [self[p] if r is None else r for p, r in zip(parts, found)]
        return found

    def _add(self, new: list[str]) -> None:
        for at in range(0, len(new), CALL_PARTS):
            some = new[at : at + CALL_PARTS]
            made = self.make(some)
            self.update(zip(some, made))
            self.held += 160 * len(some) + sum(map(len, some)) + sum(map(self.weight, made))


class ByteLevel:
    """Packed ids (unsigned 32-bit, little-endian) by a byte-level tokenizer, whose special tokens are plain text."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        names = tokenizer.get_vocab(with_added_tokens=False)  # a character of a name stands for one byte
        self.width = np.zeros(max(names.values()) + 1, np.int64)
        for name, number in names.items():
            self.width[number] = len(name)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def after_space(self, parts: list[str]) -> list[bytes]:
        """Ids of each part with a space before it.

        Parts that do not end in white space are encoded many as one text, since the space after them begins a
        pre-token; the ids are dealt back by their bytes.
        """
        alone = [k for k, p in enumerate(parts) if not p or p[-1].isspace()]
        found: list[bytes] = [b""] * len(parts)
        for k, ids in zip(alone, self.whole([" " + parts[k] for k in alone])):
            found[k] = ids
        apart = set(alone)
        rest = [k for k in range(len(parts)) if k not in apart]
        if not rest:
            return found
        spelled = [" " + parts[k] for k in rest]
        packed = b"".join(self.whole(["".join(spelled[at : at + RUN_PARTS]) for at in range(0, len(spelled), RUN_PARTS)]))
        ends = np.cumsum(self.width[np.frombuffer(packed, "<u4")])
        edges = (4 * (np.searchsorted(ends, np.cumsum(pc.binary_length(pa.array(spelled, pa.string())).to_numpy())) + 1)).tolist()
        for k, a, b in zip(rest, [0, *edges], edges):
            found[k] = packed[a:b]
        return found
