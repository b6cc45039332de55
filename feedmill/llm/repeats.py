"""Repeated passages by blockwise suffix sorting over a difference cover [op7].

A byte goes if a string of ``length`` bytes that covers it starts in at least two places, in any
documents.  Sorting all suffixes would move every text ``length`` times, so the sort is done in two
steps that each move a few bytes per suffix, one bucket of suffixes at a time:

1. *Cover sample.*  The positions of a perfect difference cover modulo 57 (8 of 57) are ranked first: each gets
   the name of the 144 bytes that follow.  For any two positions some shift below 57 puts both on the
   cover, and 144 bytes still lie inside the 200, so equal strings always meet in a pair of equal
   sample names.
2. *Candidates.*  Only starts with a repeated sample within reach can be equal to another.  They
   are dealt to buckets by name and each bucket is sorted on its own; equal neighbours are repeats.

3. *Bytes.*  A name is a 64-bit hash of the string, of which the bucket and 56 (sample: 32) more bits are sent, so
   equal names only suggest equal strings.  Every chunk that shares a name with others sends the bytes behind it to the
   chunk before it in the chain of those that asked for it, which compares them with its own; so a chunk receives each of
   its own strings at most once, however many chunks hold it.  A chain with a link of different bytes is settled by its
   strings themselves: each chunk of the chain sends them, they are counted as they are, and one that occurs once stays.

Sample names only choose candidates, so a false match there costs time, not correctness.  Lexicographic order is not
needed and not made: the buckets are ranges of names.

Texts travel once, as compressed chunks of about 2 MB, and stay with their chunk; questions go out and
answers (one bit per question) come back by chunk.  Inside a chunk equal names are asked once.  A text that
occurs several times as a whole is named by its 256-bit BLAKE2 digest and only one copy asks for its strings, so a
text held by a third of all rows costs little more than one.  Buckets hold about ``BUCKET`` questions
at any size of the input, so no task's memory grows with it.

* Null and empty texts have no bytes; shorter texts than ``length`` are kept whole.
* Texts are bytes: a span may begin inside a character, unless ``whole_characters`` shrinks spans.
* Repeated rows are repeated texts.  All other columns come back as they are; one that is named like an added
  one is replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import collections
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmill.llm.blocks import RangeHash, as_bytes, packed_chunks, unpacked

LENGTH = 200
PERIOD = 57
#: A perfect difference set: every difference modulo 57 occurs (fixed values).
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
CHUNK_BYTES = 2 << 20
PIECE_BYTES = 256 << 10
BUCKET = 2_000_000

SAMPLE, WHOLE, STRING, SINGLE = 0, 1, 2, 3
#: The bits of a string's name that are sent beside its bucket.
SENT = np.uint64((1 << 56) - 1)
_QUESTIONS = "bucket int, chunk long, kind int, names binary, copies binary"
_ANSWERS = "bucket int, chunk long, kind int, flags binary, before binary"
_LINKS = "chunk long, spans binary, marks binary, data binary"


def names_at(data: np.ndarray, starts: np.ndarray, length: int, bits: int = 64) -> np.ndarray:
    """64-bit names of the strings of ``length`` bytes at sorted ``starts``, of which the low ``bits`` are kept."""
    out, ranges = np.empty(len(starts), np.uint64), RangeHash()
    for at in range(0, len(data), PIECE_BYTES):
        a, b = np.searchsorted(starts, [at, at + PIECE_BYTES])
        if a < b:
            ranges.load(data[at : at + PIECE_BYTES + length])
            own = starts[a:b] - at
            out[a:b] = ranges.names(own, own + length)
    return out if bits == 64 else out & np.uint64((1 << bits) - 1)


def equal(one: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings at ``a`` and ``b`` have the same bytes; neighbours that go on together are read once."""
    out = np.ones(len(a), bool)
    cuts = np.flatnonzero((np.diff(a) != 1) | (np.diff(b) != 1)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]) if len(a) else ():
        differ = one[a[lo] : a[hi - 1] + length] != other[b[lo] : b[hi - 1] + length]
        if differ.any():
            before = np.cumsum(np.append(0, differ))
            out[lo:hi] = before[length:] == before[:-length]
    return out


def clashing(data: np.ndarray, starts: np.ndarray, which: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """For each name whether it stands for different strings here; each place is compared with the one before."""
    several = np.flatnonzero((times > 1)[which])
    order = several[np.argsort(which[several], kind="stable")]
    same = which[order][1:] == which[order][:-1]
    before = np.full(len(starts), -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    own = np.flatnonzero(before >= 0)
    out = np.zeros(len(times), bool)
    out[which[own[~equal(data, starts[own], data, starts[before[own]], length)]]] = True
    return out


class Chunk:
    """The different texts of a chunk that are long enough, one after another in a fixed order."""

    def __init__(self, texts: list[bytes], length: int, bits: int = 64):
        self.length, self.bits = length, bits
        copies: dict[bytes, int] = {}
        for t in texts:
            if len(t) >= length:
                copies[t] = copies.get(t, 0) + 1
        self.texts = sorted(copies)
        self.copies = np.array([min(copies[t], 2) for t in self.texts], np.uint8)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def samples(self) -> np.ndarray:
        """Cover positions with a whole sample string behind them."""
        window = self.length - PERIOD + 1
        longest = int(self.sizes.max(initial=0))
        grid = (np.arange(0, longest, PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
        counts = np.searchsorted(grid, self.sizes - window, side="right")
        return np.concatenate([o + grid[:c] for o, c in zip(self.offsets.tolist(), counts.tolist())] or [grid[:0]])

    def sample_names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(positions, different names, index of each position's name, whether a name occurs twice here)."""
        at = self.samples()
        names, which, times = np.unique(names_at(self.data, at, self.length - PERIOD + 1, self.bits), return_inverse=True, return_counts=True)
        return at, names, which, times > 1

    def names(self, starts: np.ndarray) -> np.ndarray:
        return names_at(self.data, starts, self.length, self.bits)

    def places_of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, names) of all strings whose names have the sent bits of one of ``wanted``."""
        starts = np.concatenate([np.arange(o, o + s - self.length + 1) for o, s in zip(self.offsets.tolist(), self.sizes.tolist())] or [np.zeros(0, np.int64)])
        names = self.names(starts)
        low = np.zeros(1 << 20, bool)  # most places are settled by the low bits
        low[(wanted & np.uint64(0xFFFFF)).astype(np.int64)] = True
        near = np.flatnonzero(low[(names & np.uint64(0xFFFFF)).astype(np.int64)])
        near = near[np.isin(names[near] & SENT, wanted & SENT)]
        return starts[near], names[near]

    def candidates(self, flagged: np.ndarray, repeated: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts whose string may occur elsewhere, without those of copies that another chunk asks for."""
        reach = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(reach, np.maximum(flagged - (PERIOD - 1), 0), 1)
        np.add.at(reach, flagged + 1, -1)
        possible = np.cumsum(reach[:-1], dtype=np.int32) > 0
        for i in np.flatnonzero(repeated).tolist():
            possible[self.offsets[i] : self.offsets[i] + self.sizes[i]] = first[i]
        for o, s in zip(self.offsets.tolist(), self.sizes.tolist()):
            possible[o + s - self.length + 1 : o + s] = False
        return np.flatnonzero(possible)


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    # Bits 56-63, which are not sent, come last, so 32 buckets or more tell at least five of them apart.
    return (((names >> np.uint64(32)) & np.uint64(0xFFFFFF)) * np.uint64(1 << 8) + (names >> np.uint64(56))) % np.uint64(buckets)


def _dealt(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by (bucket, name), and where each bucket's part begins."""
    bucket = _bucket(names, buckets)
    order = np.lexsort((names, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _packed(names: np.ndarray, width: int) -> bytes:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


_WIDTH = {SAMPLE: 4, STRING: 7, WHOLE: 32}


def _ask(chunk: int, kind: int, names: np.ndarray, buckets: int) -> Iterator[tuple]:
    order, edges = _dealt(names, buckets)
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, chunk, kind, _packed(names[order[edges[b] : edges[b + 1]]], _WIDTH[kind]), None


def _answered(names: np.ndarray, buckets: int, answers: dict[int, bytes]) -> np.ndarray:
    """The answers to ``_ask`` in the order of the names."""
    order, edges = _dealt(names, buckets)
    out = np.zeros(len(names), bool)
    for b in range(buckets):
        n = int(edges[b + 1] - edges[b])
        if n:
            out[order[edges[b] : edges[b + 1]]] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=n).astype(bool)
    return out


def _numbers(chunks: np.ndarray) -> bytes:
    """Chunk numbers, few of them different, in little space."""
    different, which = np.unique(chunks, return_inverse=True)
    width = "<u2" if len(different) <= 1 << 16 else "<u4"
    return len(different).to_bytes(4, "little") + different.astype("<i8").tobytes() + which.astype(width).tobytes()


def _from_numbers(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, "<i8", n, 4)[np.frombuffer(data, "<u2" if n <= 1 << 16 else "<u4", -1, 4 + 8 * n)]


def _before(names: np.ndarray, buckets: int, flags: dict[int, bytes], before: dict[int, bytes]) -> np.ndarray:
    """The chunk before this one in the chain of each name; -1 without one."""
    order, edges = _dealt(names, buckets)
    out = np.full(len(names), -1, np.int64)
    for b in range(buckets):
        own = order[edges[b] : edges[b + 1]]
        if len(own):
            shared = own[np.unpackbits(np.frombuffer(flags[b], np.uint8), count=len(own)).astype(bool)]
            if len(shared):
                out[shared] = _from_numbers(before[b])
    return out


def _answer(table: pa.Table) -> pa.Table:
    """One bucket's questions: a name is repeated if several chunks ask for it (each asks once).

    The chunks that ask for a string form a chain by their numbers; each is told which comes before it.
    """
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    out = []
    for kind in (SAMPLE, STRING):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        parts = [_unpacked(r["names"], _WIDTH[kind]) for r in own]
        names = np.concatenate(parts)
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        flags = np.zeros(len(names), bool)
        flags[order[1:][same]] = True
        flags[order[:-1][same]] = True
        edges = np.cumsum([0] + [len(p) for p in parts])
        before: list[bytes | None] = [None] * len(own)
        if kind == STRING:
            asker = np.repeat(np.array([r["chunk"] for r in own], np.int64), np.diff(edges))
            chain = np.full(len(names), -1, np.int64)
            chain[order[1:][same]] = asker[order[:-1][same]]
            before = [_numbers(chain[a:b][flags[a:b]]) for a, b in zip(edges[:-1], edges[1:])]
        out += [(r, np.packbits(flags[a:b]).tobytes(), c) for r, a, b, c in zip(own, edges[:-1], edges[1:], before)]
    texts = sorted((r for r in rows if r["kind"] == WHOLE), key=lambda r: r["chunk"])
    total: dict[bytes, int] = {}
    for r in texts:
        for i, c in enumerate(r["copies"]):
            name = r["names"][32 * i : 32 * i + 32]
            total[name] = total.get(name, 0) + c
    seen: set[bytes] = set()
    for r in texts:
        flags = bytearray()
        for i in range(len(r["copies"])):
            name = r["names"][32 * i : 32 * i + 32]
            flags.append((total[name] > 1) + 2 * (name not in seen))
            seen.add(name)
        out.append((r, bytes(flags), None))
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("flags", pa.binary()), ("before", pa.binary())])
    columns = [[r[c] for r, _, _ in out] for c in ("bucket", "chunk", "kind")] + [[o[k] for o in out] for k in (1, 2)]
    return pa.table(columns, schema=schema)


def _askers(table: pa.Table, clashes: pa.Table) -> pa.Table:
    """(chunk, names) of those who asked this bucket for a clashing name."""
    wanted = np.unique(np.concatenate([_unpacked(n, 8) for n in clashes["names"].to_pylist()] or [np.zeros(0, np.uint64)]))
    out = []
    if len(wanted):
        for r in table.to_pylist():
            if r["kind"] == STRING:
                own = np.isin(wanted & SENT, _unpacked(r["names"], _WIDTH[STRING]))
                if own.any():
                    out.append((r["chunk"], _packed(wanted[own], 8)))
    columns = list(zip(*out)) or [[]] * 2
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["chunk", "names"])


def _whole(chunk: Chunk, number: int, buckets: int) -> tuple[list[bytes], list[list[int]]]:
    names = [hashlib.blake2b(t, digest_size=32).digest() for t in chunk.texts]
    dealt: list[list[int]] = [[] for _ in range(buckets)]
    for i, name in enumerate(names):
        dealt[int.from_bytes(name[:8], "little") % buckets].append(i)
    return names, dealt


def _from_answers(chunk: Chunk, number: int, buckets: int, rows: list[dict]):
    """(candidate starts, repeated texts) as the first answers say."""
    by_kind: dict[int, dict[int, bytes]] = {SAMPLE: {}, WHOLE: {}, STRING: {}}
    for r in rows:
        if r["kind"] == SINGLE:
            continue
        by_kind[r["kind"]][r["bucket"]] = r["flags"]
    at, names, which, local = chunk.sample_names()
    flagged = at[(_answered(names, buckets, by_kind[SAMPLE]) | local)[which]]
    marks = np.zeros(len(chunk.texts), np.uint8)
    for b, own in enumerate(_whole(chunk, number, buckets)[1]):
        if own:
            marks[own] = np.frombuffer(by_kind[WHOLE][b], np.uint8)
    repeated = (marks & 1).astype(bool)
    return chunk.candidates(flagged, repeated, (marks & 2) > 0), repeated, by_kind[STRING]


def _inside(covered: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Covered bytes whose whole UTF-8 character is covered."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts):
        return covered
    whole = np.logical_and.reduceat(covered, starts)
    return covered & np.repeat(whole, np.diff(np.append(starts, len(data))))


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, whole_characters: bool = False, bucket: int = BUCKET, name_bits: int = 64
) -> DataFrame:
    """Every row without its text but with kept (bytes), n_bytes, n_removed and n_spans.

    The result is the same for any ``name_bits``; fewer let different strings share names, so more of them are compared.
    """
    added = [T.StructField("kept", T.BinaryType())] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    names = {f.name for f in added} | {text}
    carried = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(carried + added)
    columns = [f.name for f in carried]
    total = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    buckets = max(32, -(-total * len(COVER) // (PERIOD * bucket)))

    def questions(rows) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "chunk", "kind", "names", "copies"])

    def first(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunk = Chunk(as_bytes(unpacked(blob).column(0).combine_chunks()), length, name_bits)
                if chunk.texts:
                    yield questions(_ask(number, SAMPLE, chunk.sample_names()[1], buckets))
                    texts, dealt = _whole(chunk, number, buckets)
                    yield questions(
                        (b, number, WHOLE, b"".join(texts[i] for i in own), chunk.copies[own].tobytes()) for b, own in enumerate(dealt) if own
                    )

    def second(rows: pa.Table, answers: pa.Table) -> pa.Table:
        number, blob = rows["chunk"][0].as_py(), rows["blob"][0].as_py()
        chunk = Chunk(as_bytes(unpacked(blob).column(0).combine_chunks()), length, name_bits)
        asked = []
        if chunk.texts:
            starts, _, _ = _from_answers(chunk, number, buckets, answers.to_pylist())
            asked = list(_ask(number, STRING, np.unique(chunk.names(starts)), buckets))
        return pa.Table.from_batches([questions(asked)])

    def third(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """The bytes behind shared names, to the chunk before in each chain; all places of a name that clashes here."""
        number, blob = rows["chunk"][0].as_py(), rows["blob"][0].as_py()
        chunk = Chunk(as_bytes(unpacked(blob).column(0).combine_chunks()), length, name_bits)
        out: list[tuple] = []
        if chunk.texts:
            told = answers.to_pylist()
            starts, _, replies = _from_answers(chunk, number, buckets, told)
            names, at, which, times = np.unique(chunk.names(starts), return_index=True, return_inverse=True, return_counts=True)
            before = _before(names, buckets, replies, {r["bucket"]: r["before"] for r in told if r["kind"] == STRING})
            sent = clashing(chunk.data, starts, which, times, length)[which]
            sent[at] = True
            places = np.flatnonzero(sent & (before[which] >= 0))
            places = places[np.argsort(before[which[places]], kind="stable")]
            to = before[which[places]]
            for group in np.split(np.arange(len(places)), np.flatnonzero(np.diff(to)) + 1) if len(places) else ():
                receiver, own = int(to[group[0]]), starts[places[group]]
                cuts = np.flatnonzero(np.diff(own) > length) + 1
                firsts, lasts = own[np.append(0, cuts)], own[np.append(cuts, len(own)) - 1]
                spans = lasts - firsts + length
                offsets = np.cumsum(spans) - spans
                marks = np.zeros(int(spans.sum()), bool)
                marks[own - np.repeat(firsts - offsets, np.diff(np.append(np.append(0, cuts), len(own))))] = True
                data = b"".join(chunk.data[f : f + n].tobytes() for f, n in zip(firsts.tolist(), spans.tolist()))
                out.append((receiver, spans.astype("<u4").tobytes(), np.packbits(marks).tobytes(), data))
        columns = list(zip(*out)) or [[]] * 4
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "spans", "marks", "data"])

    def compared(rows: pa.Table, links: pa.Table) -> pa.Table:
        """The names behind which the received bytes, or the own ones, differ."""
        found = np.zeros(0, np.uint64)
        if len(rows) and len(links):
            chunk = Chunk(as_bytes(unpacked(rows["blob"][0].as_py()).column(0).combine_chunks()), length, name_bits)
            got = []
            for r in links.to_pylist():
                data = np.frombuffer(r["data"], np.uint8)
                starts = np.flatnonzero(np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=len(data)))
                got.append((data, starts, names_at(data, starts, length, name_bits)))
            own, at = chunk.places_of(np.unique(np.concatenate([g[2] for g in got])))
            names, first_at, which, times = np.unique(at & SENT, return_index=True, return_inverse=True, return_counts=True)
            unlike = clashing(chunk.data, own, which, times, length)
            wrong = []
            for data, starts, asked in got:
                place = np.searchsorted(names, asked & SENT)  # this chunk asked for each of them
                wrong.append(asked[unlike[place] | ~equal(data, starts, chunk.data, own[first_at[place]], length)])
            found = np.unique(np.concatenate(wrong))
        order, edges = _dealt(found, buckets)
        out = [(b, _packed(found[order[edges[b] : edges[b + 1]]], 8)) for b in range(buckets) if edges[b] < edges[b + 1]] if len(found) else []
        columns = list(zip(*out)) or [[]] * 2
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], names=["bucket", "names"])

    def spelled(rows: pa.Table, clashes: pa.Table) -> pa.Table:
        """Every place of a clashing name in a chunk that asked for it, with its bytes."""
        out: list[tuple] = []
        if len(rows) and len(clashes):
            chunk = Chunk(as_bytes(unpacked(rows["blob"][0].as_py()).column(0).combine_chunks()), length, name_bits)
            wanted = np.unique(np.concatenate([_unpacked(n, 8) for n in clashes["names"].to_pylist()]))
            counts: dict[bytes, int] = {}
            asked = set(zip(_bucket(wanted, buckets).tolist(), (wanted & SENT).tolist()))
            starts, names = chunk.places_of(wanted)
            for start, *name in zip(starts.tolist(), _bucket(names, buckets).tolist(), (names & SENT).tolist()):
                if tuple(name) not in asked:
                    continue
                string = chunk.data[start : start + length].tobytes()
                counts[string] = counts.get(string, 0) + 1
            out = [(rows["chunk"][0].as_py(), string, n) for string, n in counts.items()]
        columns = list(zip(*out)) or [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int64()))], names=["chunk", "string", "n"])

    def last(rows: pa.Table, answers: pa.Table) -> pa.Table:
        number, blob = rows["chunk"][0].as_py(), rows["blob"][0].as_py()
        table = unpacked(blob)
        texts = as_bytes(table.column(0).combine_chunks())
        chunk = Chunk(texts, length, name_bits)
        found: dict[bytes, tuple[bytes, int, int]] = {}
        if chunk.texts:
            told = answers.to_pylist()
            starts, repeated, replies = _from_answers(chunk, number, buckets, told)
            names, which, times = np.unique(chunk.names(starts), return_inverse=True, return_counts=True)
            asked_twice = _answered(names, buckets, replies)
            goes = (asked_twice | (times > 1))[which]
            single = {r["flags"] for r in told if r["kind"] == SINGLE}
            alone = names_at(np.frombuffer(b"".join(single), np.uint8), np.arange(len(single)) * length, length, name_bits)
            unlike = ~asked_twice & clashing(chunk.data, starts, which, times, length)
            doubtful = np.flatnonzero(goes & (unlike | np.isin(names, alone))[which]).tolist()
            strings = [chunk.data[starts[i] : starts[i] + length].tobytes() for i in doubtful]
            here = collections.Counter(strings)
            for i, string in zip(doubtful, strings):
                goes[i] = here[string] > 1 if unlike[which[i]] else string not in single
            starts = starts[goes]
            depth = np.zeros(len(chunk.data) + 1, np.int32)
            depth[starts] += 1
            depth[starts + length] -= 1  # starts differ, so no index occurs twice
            covered = np.cumsum(depth[:-1], dtype=np.int32) > 0
            for i, t in enumerate(chunk.texts):
                own = slice(chunk.offsets[i], chunk.offsets[i] + chunk.sizes[i])
                gone = np.ones(len(t), bool) if repeated[i] else covered[own]
                if whole_characters:
                    gone = _inside(gone, chunk.data[own])
                if gone.any():
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    found[t] = (chunk.data[own][~gone].tobytes(), int(gone.sum()), spans)
        result = [found.get(t, (t, 0, 0)) for t in texts]
        out = [pa.array([r[0] for r in result], pa.binary()), pa.array([len(t) for t in texts], pa.int64())]
        out += [pa.array([r[k] for r in result], pa.int64()) for k in (1, 2)]
        return pa.table([table.column(c) for c in columns] + out, names=columns + [f.name for f in added])

    packed = packed_chunks(docs.select(text, *columns), text, CHUNK_BYTES).repartition("chunk")
    asked = packed.mapInArrow(first, _QUESTIONS)
    answers = asked.groupBy("bucket").applyInArrow(_answer, _ANSWERS).repartition("chunk")
    more = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(second, _QUESTIONS).repartition("bucket")
    replies = more.groupBy("bucket").applyInArrow(_answer, _ANSWERS).repartition("chunk")
    told = answers.union(replies)
    links = packed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(third, _LINKS)
    clashes = packed.groupBy("chunk").cogroup(links.groupBy("chunk")).applyInArrow(compared, "bucket int, names binary")
    askers = more.groupBy("bucket").cogroup(clashes.groupBy("bucket")).applyInArrow(_askers, "chunk long, names binary")
    strings = packed.groupBy("chunk").cogroup(askers.groupBy("chunk")).applyInArrow(spelled, "chunk long, string binary, n long")
    single = strings.groupBy("string").agg(F.sum("n").alias("n"), F.min("chunk").alias("chunk")).filter("n = 1")
    single = single.select(F.lit(-1).alias("bucket"), "chunk", F.lit(SINGLE).alias("kind"), F.col("string").alias("flags"))
    told = told.drop("before").union(single)
    return packed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(last, schema)
