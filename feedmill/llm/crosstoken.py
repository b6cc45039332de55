"""Cross-tokenizer alignment by products of sparse incidence matrices [op11].

Two tokenizers cut the same bytes.  Tokenizer A is byte-level BPE (a JSON file), B marks word starts and falls back to bytes
(a model file); A encodes a space and the text, B the text, to which it adds the space itself.

* The token-byte incidence matrix of a tokenizer has a row for each token and a column for each byte.  It is held in
  compressed sparse rows built by hand (``Csr``), and Gustavson's row product A * B' gives for each token of A the tokens of
  B that it shares bytes with, and how many: the overlap links.
* Byte offsets where tokens of both end cut the tokens into groups.  The group incidence of A times that of B' gives the
  pairs that share a group.  A group without inner cuts may be long, so these rows stay ranges and only their sizes
  are summed (``n_shared``).
* Texts are cut at spaces, where tokens of both always begin; the products are made once for each different part of a block
  and put together for each document.  Where a model's vocabulary or normalisation does not allow the cut, whole texts
  are the parts.
* How many documents hold a pair of ids linked is counted over the corpus: each chunk of documents counts its different
  pairs, these partial counts are summed by pair, and each chunk asks back for its pairs.  So a common pair is
  one row per chunk, and no document's links are shuffled.  The chunk keeps its documents as a sparse document-pair matrix,
  whose product with the counts gives the sums.

* Texts that are null or empty, or whose token bytes of A or B differ from the space and the text, have no tokens: all numbers
  are zero and the groups empty.  Their strings of special tokens are plain text.
* Repeated rows are documents of their own and count each.  Other columns are not moved unless in ``carry``; a carried
  column that is named like an added one is replaced by it.  An empty table gives an empty result.
* A text of any length is worked off in parts, but one part without spaces is encoded whole, as both libraries do.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmill.llm.blocks import as_bytes, byte_sizes, gather, in_slices
from feedmill.llm.words import CALL_PARTS, ByteLevel, parts_of
from feedmill.session import staged

#: Bytes of text whose pairs are counted together.
CHUNK_BYTES = 6 << 20
#: Bytes of text that are aligned in one go.
SLICE_BYTES = 1 << 20
#: Bytes of parts and their alignments that a task remembers.
REMEMBERED_BYTES = 192 << 20
#: Pairs of ids are one number: a * 2**24 + b.
SHIFT = 24


# --- sparse matrices ----------------------------------------------------------------------


@dataclass(frozen=True)
class Csr:
    """Compressed sparse rows: row r has the columns ``index[start[r]:start[r + 1]]`` with their ``data``."""

    start: np.ndarray
    index: np.ndarray
    data: np.ndarray

    def row_sizes(self) -> np.ndarray:
        return np.diff(self.start)

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self.start) - 1), self.row_sizes())


def ranges(lengths: np.ndarray) -> Csr:
    """The incidence of consecutive ranges: row r has the next ``lengths[r]`` columns."""
    start = np.append(0, np.cumsum(lengths))
    return Csr(start, np.arange(start[-1]), np.ones(start[-1], np.int64))


def transposed(matrix: Csr, columns: int) -> Csr:
    order = np.argsort(matrix.index, kind="stable")
    start = np.append(0, np.cumsum(np.bincount(matrix.index, minlength=columns)))
    return Csr(start, matrix.rows()[order], matrix.data[order])


def product(left: Csr, right: Csr, columns: int) -> Csr:
    """Gustavson's product: row r is the sum of the rows of ``right`` that row r of ``left`` names, times its entries."""
    sizes = right.row_sizes()[left.index]
    column = gather(right.index, right.start[left.index], sizes)
    value = gather(right.data, right.start[left.index], sizes) * np.repeat(left.data, sizes)
    key = np.repeat(left.rows(), sizes) * columns + column
    if len(key) and (key[1:] < key[:-1]).any():  # rows of a product of ranges come in order already
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    summed = np.add.reduceat(value, first) if len(first) else value
    row, index = np.divmod(key[first], max(columns, 1))
    return Csr(np.append(0, np.cumsum(np.bincount(row, minlength=len(left.start) - 1))), index, summed)


# --- tokenizers ---------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenBytes:
    """The bytes of every id."""

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens) + 1
        self.length = np.zeros(size, np.int64)
        for number, token in tokens.items():
            self.length[number] = len(token)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens[n] for n in sorted(tokens)), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.start[ids], self.length[ids])


class Tokenizers:
    """Both tokenizers and the bytes of their tokens, made inside a task from the contents of their files."""

    def __init__(self, json: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a, self.b = Tokenizer.from_str(json), SentencePieceProcessor(model_proto=model)
        a.encode_special_tokens = True
        self.a = ByteLevel(a)
        alphabet = byte_alphabet()
        self.a_bytes = TokenBytes({n: bytes(alphabet[c] for c in name) for name, n in a.get_vocab(with_added_tokens=False).items()})
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.b_bytes = TokenBytes(
            {n: bytes([int(p[1:-1], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)}
        )
        self.digits = Digits(max(len(self.a_bytes.length), len(self.b_bytes.length)))
        crossing = any("▁" in p.lstrip("▁") for p in pieces)
        # Without normalisation the pieces of a text with spaces in all places spell it with a space before it.
        self.can_cut = not crossing and "".join(self.b.encode(" a  b ", out_type=str)) == "▁▁a▁▁b▁"

    def ids(self, parts: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        """Ids of a space and each part by A, and of each part by B, which adds the space."""
        a = self.a.after_space(parts) if self.can_cut else self.a.whole([" " + p for p in parts])
        return [np.frombuffer(ids, "<u4") for ids in a], self.b.encode(parts, num_threads=1)


# --- parts of texts -----------------------------------------------------------------------

#: Numbers of a part, of a document and of the result.
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


@dataclass(frozen=True)
class Lists:
    """Values of consecutive owners, one after another: owner k has ``values[start[k]:start[k + 1]]``."""

    start: np.ndarray
    values: np.ndarray

    def of(self, owners: np.ndarray) -> np.ndarray:
        return gather(self.values, self.start[owners], self.start[owners + 1] - self.start[owners])


def sums_of(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the stretches from one start to the next, along the first axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[start[1:]] - total[start[:-1]]


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def overlap_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Csr:
    """Token-byte incidence of A times that of B transposed: shared bytes of each pair of tokens."""
    a, b = ranges(a_lengths), ranges(b_lengths)
    return product(a, transposed(b, len(b.index)), len(b_lengths))


def group_incidence(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(group of each token of A, group of each token of B, number of groups): cut where tokens of both end."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends), len(ends)


class Digits:
    """Decimal spellings of ids, each with a place for the mark that follows it."""

    def __init__(self, size: int):
        self.length = np.array([len(str(n)) + 1 for n in range(size)])
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer("".join([f"{n} " for n in range(size)]).encode(), np.uint8)

    def groups(self, a_ids, a_group, b_ids, b_group, n_groups: int) -> Lists:
        """``a1,a2|b1;`` of every group."""
        ids, group = np.concatenate([a_ids, b_ids]), np.concatenate([a_group, b_group])
        run = 2 * group
        run[len(a_ids) :] += 1
        order = np.argsort(run, kind="stable")
        ids, run = ids[order], run[order]
        sizes = self.length[ids]
        out = gather(self.flat, self.start[ids], sizes)
        ends = np.cumsum(sizes)
        last = np.append(run[1:] != run[:-1], True)
        out[ends - 1] = np.where(last, np.where(run % 2, ord(";"), ord("|")), ord(","))
        return Lists(np.append(0, ends)[np.searchsorted(run, 2 * np.arange(n_groups + 1))], out)


@dataclass(frozen=True)
class Parts:
    """Alignments of parts: whether token bytes spell the part, its numbers, the id pairs of its links and its groups."""

    good: np.ndarray
    numbers: np.ndarray
    links: Lists
    groups: Lists


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(own) for own in lists], np.int64)
    if lists and isinstance(lists[0], np.ndarray):
        return np.concatenate(lists).astype(np.int64), counts
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def align_parts(tokenizers: Tokenizers, parts: list[str]) -> Parts:
    """The alignment of each part with a space before it; parts that their tokens do not spell have none."""
    wanted = [b" " + p.encode() for p in parts]
    sizes = np.array([len(w) for w in wanted])
    good = np.ones(len(parts), bool)
    sides = []
    for lists, table in zip(tokenizers.ids(parts), (tokenizers.a_bytes, tokenizers.b_bytes)):
        ids, counts = _flat(lists)
        good &= sums_of(table.length[ids], starts(counts)) == sizes
        sides.append((ids, counts, table))
    text = Lists(starts(sizes), np.frombuffer(b"".join(wanted), np.uint8))
    for ids, counts, table in sides:  # parts of the right size: compare byte by byte
        left = np.flatnonzero(good)
        differs = table.of(ids[np.repeat(good, counts)]) != text.of(left)
        good[np.repeat(left, sizes[left])[differs]] = False
    (a_ids, a_counts, a_lengths), (b_ids, b_counts, b_lengths) = [
        (own := ids[np.repeat(good, counts)], np.where(good, counts, 0), table.length[own]) for ids, counts, table in sides
    ]
    links = overlap_links(a_lengths, b_lengths)  # tokens of different parts share no byte
    a_group, b_group, n_groups = group_incidence(a_lengths, b_lengths)
    shared = np.bincount(b_group, minlength=n_groups)[a_group]  # row sizes of the group product
    a_start = starts(a_counts)
    link_start = links.start[a_start]
    group_start = np.append(a_group, n_groups)[a_start]
    spelled = tokenizers.digits.groups(a_ids, a_group, b_ids, b_group, n_groups)
    numbers = np.stack([a_counts, b_counts, np.diff(group_start), np.diff(link_start), sums_of(shared, a_start)], axis=1)
    pairs = (a_ids[links.rows()] << SHIFT) | b_ids[links.index]
    return Parts(good, numbers, Lists(link_start, pairs), Lists(spelled.start[group_start], spelled.values))


class Growing:
    """An array that grows at its end."""

    def __init__(self, shape: tuple[int, ...], kind: type):
        self.room, self.size = np.empty(shape, kind), 0

    def add(self, rows: np.ndarray) -> None:
        if self.size + len(rows) > len(self.room):
            room = np.empty((2 * (self.size + len(rows)), *self.room.shape[1:]), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : self.size + len(rows)] = rows
        self.size += len(rows)

    def all(self) -> np.ndarray:
        return self.room[: self.size]


class Aligner:
    """Alignments of whole texts: a document-part matrix times the alignments of the different parts.

    Parts are remembered in columns, up to ``REMEMBERED_BYTES``; then the memory starts anew.
    """

    def __init__(self, json: str, model: bytes):
        self.tokenizers = Tokenizers(json, model)
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.held = 0
        self.good, self.numbers = Growing((0,), bool), Growing((0, len(NUMBERS)), np.int32)
        self.link_start, self.links = Growing((0,), np.int64), Growing((0,), np.int64)
        self.group_start, self.groups = Growing((0,), np.int64), Growing((0,), np.uint8)
        self.link_start.add(np.zeros(1, np.int64))
        self.group_start.add(np.zeros(1, np.int64))

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.row]
        if new and self.held > REMEMBERED_BYTES:
            self._forget()
            new = list(parts)
        for at in range(0, len(new), CALL_PARTS):
            some = new[at : at + CALL_PARTS]
            found = align_parts(self.tokenizers, some)
            self.row.update(zip(some, range(self.good.size, self.good.size + len(some))))
            self.link_start.add(self.links.size + found.links.start[1:])
            self.group_start.add(self.groups.size + found.groups.start[1:])
            for column, rows in ((self.good, found.good), (self.numbers, found.numbers), (self.links, found.links.values), (self.groups, found.groups.values)):
                column.add(rows)
            self.held += 240 * len(some) + sum(map(len, some)) + found.links.values.nbytes + found.groups.values.nbytes

    def many(self, texts: Sequence[str]) -> tuple[np.ndarray, Lists, Lists]:
        """(numbers, id pairs of the links, groups) of each text; zeros and nothing for texts without tokens."""
        cut = [([] if not t else parts_of(t) if self.tokenizers.can_cut else [t]) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        sizes = np.array([len(own) for own in cut], np.int64)
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        bad = sums_of(~self.good.all()[rows], starts(sizes)) > 0
        rows, sizes = rows[np.repeat(~bad, sizes)], np.where(bad, 0, sizes)
        start = starts(sizes)
        numbers = sums_of(self.numbers.all()[rows], start)
        links = Lists(self.link_start.all(), self.links.all())
        groups = Lists(self.group_start.all(), self.groups.all())
        spelled = groups.of(rows)
        group_sizes = sums_of(groups.start[rows + 1] - groups.start[rows], start)
        return numbers, Lists(starts(numbers[:, 3]), links.of(rows)), Lists(starts(group_sizes), spelled)


# --- the corpus ---------------------------------------------------------------------------

ADDED = [*NUMBERS, "n_best", "count_sum", "groups_sha256"]
CHUNKS = "chunk long, docs binary, pairs array<long>, holding array<int>"


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _lists(start: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(start, pa.int64()), pa.array(values.astype(np.int32)))


def _chunk(number: int, kept: pa.Table, numbers: np.ndarray, digests: list[str], links: np.ndarray) -> pa.RecordBatch:
    """One row: the documents with their sparse rows over the chunk's different pairs, these, and how many hold each."""
    pairs, which = np.unique(links, return_inverse=True)
    # A link is one entry of the document-pair matrix; equal entries of a row are summed.
    key = np.sort(np.repeat(np.arange(len(numbers)), numbers[:, 3]) * max(len(pairs), 1) + which)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    row, index = np.divmod(key[first], max(len(pairs), 1))
    start = starts(np.bincount(row, minlength=len(numbers)))
    columns = dict(zip(kept.column_names, kept.columns)) | {n: pa.array(numbers[:, k]) for k, n in enumerate(NUMBERS)}
    columns |= {"groups_sha256": pa.array(digests, pa.string()), "which": _lists(start, index), "times": _lists(start, times)}
    holding = np.bincount(index, minlength=len(pairs)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()), pa.array([_stream(pa.table(columns))], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs, pa.int64())),
            pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(holding, pa.int32())),
        ],
        names=["chunk", "docs", "pairs", "holding"],
    )


def aligned_chunks(df: DataFrame, json: str, model: bytes, carry: Sequence[str], text: str) -> DataFrame:
    """Documents in chunks of about ``CHUNK_BYTES`` of text, where tasks read them: making them moves nothing."""
    shared = df.sparkSession.sparkContext.broadcast((json, model))  # two vocabulary files
    rows = df.select(*carry, F.col(text).alias("_text"))

    def run(batches):
        aligner, number = Aligner(*shared.value), TaskContext.get().partitionId() << 32
        rows, numbers, digests, links, held = [], [], [], [], 0

        def chunk():
            return _chunk(number, pa.Table.from_batches(rows), np.concatenate(numbers), digests, np.concatenate(links))

        for batch in in_slices(batches, "_text", SLICE_BYTES):
            texts = [t.decode("utf-8", "replace") for t in as_bytes(batch.column(len(carry)))]
            own, pairs, groups = aligner.many(texts)
            numbers.append(own)
            links.append(pairs.values)
            edges = groups.start.tolist()  # every group ends in a mark, the last one's is not part of the text
            digests += [hashlib.sha256(groups.values[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(edges, edges[1:])]
            rows.append(batch.select(carry))
            held += sum(byte_sizes(batch.column(len(carry))))
            if held >= CHUNK_BYTES:
                yield chunk()
                rows, numbers, digests, links, held, number = [], [], [], [], 0, number + 1
        if rows:
            yield chunk()

    return rows.mapInArrow(run, CHUNKS)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, documents, best): documents that hold each pair, and whether no pair with the same id of A is held by more."""
    held = chunks.select(F.explode(F.arrays_zip("pairs", "holding")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holding").alias("n"))
    counts = staged(held.groupBy("pair").agg(F.sum("n").alias("documents")), "counts")
    first = F.shiftright("pair", SHIFT)
    most = counts.groupBy(first.alias("_a")).agg(F.max("documents").alias("_most"))  # a row for each id of A
    return counts.join(most, first == F.col("_a")).select("pair", "documents", (F.col("documents") == F.col("_most")).alias("best"))


def _settled(fields: list[str]) -> Callable:
    def run(key, docs, answers):
        table = pa.ipc.open_stream(docs.column("docs")[0].as_py()).read_all()
        answers = answers.sort_by("pair")  # the chunk's pairs in their order
        count = answers.column("documents").to_numpy().astype(np.int64)
        best = answers.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
        which, times = table.column("which").combine_chunks(), table.column("times").combine_chunks()
        start = np.asarray(which.offsets)
        index, entry = which.values.to_numpy(), times.values.to_numpy().astype(np.int64)
        for name, vector in (("n_best", best), ("count_sum", count)):  # the document-pair matrix times a vector
            sums = np.append(0, np.cumsum(entry * vector[index]))
            table = table.append_column(name, pa.array(sums[start[1:]] - sums[start[:-1]], pa.int64()))
        return table.select(fields)

    return run


def link_statistics(df: DataFrame, json: str, model: bytes, carry: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns of every document with its numbers of tokens, groups, links and shared pairs, ``n_best`` (links whose
    pair is held by the most documents of all pairs with its id of A), ``count_sum`` (documents of the pairs of all links) and
    the digest of its groups."""
    kept = [c for c in dict.fromkeys(carry) if c not in ADDED and c not in ("which", "times")]
    chunks = staged(aligned_chunks(df, json, model, kept, text), "chunks")
    counts = staged(pair_counts(chunks), "counts")
    asked = chunks.select(F.col("chunk").alias("asker"), F.explode("pairs").alias("pair"))
    answers = asked.join(counts, "pair").select("asker", "pair", "documents", "best")
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.StringType() if c == "groups_sha256" else T.LongType()) for c in ADDED])
    met = chunks.select("chunk", "docs").groupBy("chunk").cogroup(answers.groupBy("asker"))
    return met.applyInArrow(_settled(schema.names), schema)


ALIGNED = [
    T.StructField("a_ids", T.ArrayType(T.IntegerType())),
    T.StructField("b_ids", T.ArrayType(T.IntegerType())),
    T.StructField("groups", T.StringType()),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "b", "bytes")]))),
]


def align(df: DataFrame, json: str, model: bytes, text: str = "text") -> DataFrame:
    """Every row with the ids of both tokenizers, its groups and its overlap links (positions and shared bytes)."""
    shared = df.sparkSession.sparkContext.broadcast((json, model))
    names = [f.name for f in ALIGNED]
    kept = [f for f in df.schema.fields if f.name not in names]

    def run(batches):
        tokenizers = Tokenizers(*shared.value)
        for batch in in_slices(batches, text, SLICE_BYTES):
            texts = [t.decode("utf-8", "replace") for t in as_bytes(batch.column(batch.schema.get_field_index(text)))]
            columns: list[list] = [[], [], [], []]
            for t in texts:
                own = align_parts(tokenizers, [t]) if t else None
                spelled = own is not None and bool(own.good[0])
                a, b = [list(map(int, x[0])) for x in tokenizers.ids([t])] if spelled else ([], [])
                matrix = overlap_links(tokenizers.a_bytes.length[np.array(a, np.int64)], tokenizers.b_bytes.length[np.array(b, np.int64)])
                links = [{"a": i, "b": j, "bytes": n} for i, j, n in zip(matrix.rows().tolist(), matrix.index.tolist(), matrix.data.tolist())]
                for column, value in zip(columns, (a, b, own.groups.values.tobytes().decode()[:-1] if spelled else "", links)):
                    column.append(value)
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.list_(pa.struct([(n, pa.int32()) for n in ("a", "b", "bytes")]))]
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + names)

    return df.mapInArrow(run, T.StructType(kept + ALIGNED))
