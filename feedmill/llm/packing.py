"""Best-fit packing of token sequences with certified partitions [op12].

A document is its token ids and an end id.  Documents longer than a sequence are cut into whole sequences from
their end, so only their first piece may be shorter; all other documents stay whole.  Whole sequences are settled; what is
shorter is packed:

* Pieces are dealt to partitions of about ``ITEMS`` pieces by a hash, so a partition fits one task whatever the table is.
  Only (item, length) is moved, never texts or ids.
* Each partition is packed by best-fit decreasing.  A bitmap of the free spaces in use gives the fullest
  sequence that still takes a piece in constant time.
* Dual feasible functions of the lengths give a lower bound on the sequences that any packing of the partition
  needs.  A partition that reaches its bound is certified and settled.
* Partitions with a gap exchange: ``FAN`` of them give the pieces of all sequences that are not full, deal them anew among
  themselves and run best-fit decreasing again.  They keep the result if the exchange needs fewer sequences or none is
  lost, and the rounds end when all are certified, a round gains nothing, or after ``ROUNDS``.

The result is always whole; rounds only lower the number of sequences.

* A null text is an empty one: a single end id.  Null and repeated ids are rows like any other; equal rows are packed each.
* Equal lengths are ordered by item number, which follows the order of the rows in their files.
* An empty table gives an empty result.  Columns of the input that are not in ``carry`` are not moved; a carried column
  that is named like an added one is replaced by it.
* Texts are cut where pre-tokens surely begin (``pieces_of``) and each different piece of a block is encoded once, so a text of
  any length takes little more than its ids; a piece without such a place is encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmill.llm.blocks import as_texts, gather, in_slices
from feedmill.llm.words import CALL_PARTS, ByteLevel, Remembered, pieces_of
from feedmill.session import staged

ITEMS = 1 << 16
FAN = 4
ROUNDS = 6
#: Bytes of text that a task holds unpacked at a time.
SLICE_BYTES = 4 << 20
#: Largest k of the rounding functions.
MOST_K = 64

PIECES = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]
ADDED = [*[f.name for f in PIECES], "sequence_id", "offset", "certified"]


class TokenIds:
    """Packed little-endian 32-bit ids of texts by a byte-level tokenizer."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(tokenizer)
        own.encode_special_tokens = True
        encoder = ByteLevel(own)
        self.first, self.rest = Remembered(encoder.whole), Remembered(encoder.after_space)

    def many(self, texts: Sequence[str]) -> list[bytes]:
        ids, ends = self.joined(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in pairwise([0, *ends.tolist()])]

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many there are up to the end of each text."""
        pieces, ends = pieces_of(texts)
        coded = pieces.dictionary_encode()  # each different piece of a block is looked up once
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self.rest.results([p[1:] for p in different if p[0] == " "])
        order = np.argsort(np.array([p[0] != " " for p in different], bool), kind="stable")
        found += self.first.results([p for p in different if p[0] != " "])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[coded.indices.to_numpy()]
        known, lengths = np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], np.int64)
        starts = np.cumsum(lengths) - lengths
        stretches = [codes[at : at + CALL_PARTS] for at in range(0, len(codes), CALL_PARTS)]
        ids = [known[:0], *(gather(known, starts[c], lengths[c]) for c in stretches)]
        return np.concatenate(ids), np.append(0, np.cumsum(lengths[codes]))[ends]


def kept_ids(held: dict) -> TokenIds:
    """The encoder of a worker, with the parts that it remembers; made by the first task."""
    if "ids" not in held:
        held["ids"] = TokenIds(held["tokenizer"])
    return held["ids"]


def piece_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document: whole sequences from its end, the first one takes the rest."""
    whole, rest = divmod(total, capacity)
    return ([rest] if rest else []) + [capacity] * whole


def cut_documents(df: DataFrame, tokenizer: str, capacity: int, end_id: int, carry: Sequence[str], text: str) -> DataFrame:
    """One row per piece with its place in the document and a checksum of its ids.

    ``_item`` numbers the pieces; a task that is repeated gives the same numbers, as it reads the same files.
    """
    # A vocabulary file: its size does not depend on the data.  A Python worker keeps what it makes of it for its next tasks.
    shared = df.sparkSession.sparkContext.broadcast({"tokenizer": tokenizer})
    kept = [c for c in dict.fromkeys(carry) if c not in ADDED and c != "_item"]
    rows = df.select(*kept, F.col(text).alias("_text"))
    schema = T.StructType([df.schema[c] for c in kept] + PIECES + [T.StructField("_item", T.LongType())])

    def run(batches):
        encoder, number, end = kept_ids(shared.value), TaskContext.get().partitionId() << 40, end_id.to_bytes(4, "little")
        for batch in in_slices(batches, "_text", SLICE_BYTES):
            ids, ends = encoder.joined(as_texts(batch.column(len(kept))))
            row, piece, start, length, crc = [], [], [], [], []
            for i, (a, b) in enumerate(pairwise([0, *ends.tolist()])):
                at = 0
                for k, n in enumerate(piece_lengths(b - a + 1, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[a + at : min(a + at + n, b)]))
                    at += n
                crc[-1] = zlib.crc32(end, crc[-1])  # the end id is the last of the last piece
            taken = batch.select(kept).take(pa.array(row, pa.int64())) if kept else None
            columns = [taken.column(i) for i in range(len(kept))]
            columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            columns += [pa.array(range(number, number + len(row)), pa.int64())]
            number += len(row)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each item, offset of each item, number of bins); equal lengths keep their order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    used, count = 0, 0  # bit f of ``used``: some open bin has f places free
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = used >> n
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + n
            own = open_bins[free].pop()
            if not open_bins[free]:
                used ^= 1 << free
        else:
            own, free, count = count, capacity, count + 1
        bins[i], offsets[i] = own, capacity - free
        if free > n:
            open_bins[free - n].append(own)
            used |= 1 << (free - n)
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual feasible functions in whole numbers.

    A function f with sum f(x) <= 1 over every set of sizes x that fits one bin gives the bound sum f.
    * Threshold t: more than capacity - t counts as a whole bin, less than t as nothing, the rest as it is.
    * Rounding k: floor((k + 1) x) / k, or x itself where (k + 1) x is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    above = np.append(np.cumsum(count[::-1])[::-1], 0)  # above[s]: items of s or more
    sums = np.append(0, np.cumsum(count * size))  # sums[s]: total of the items below s
    t = np.arange(1, capacity // 2 + 1)
    by_threshold = above[capacity - t + 1] * capacity + sums[capacity - t + 1] - sums[t]
    best = max(-(-int(count @ size) // capacity), int((-(-by_threshold // capacity)).max(initial=0)))
    for k in range(1, MOST_K + 1):
        whole, rest = np.divmod((k + 1) * size, capacity)
        value = np.where(rest == 0, k * size, whole * capacity)  # f(x) * k * capacity
        best = max(best, -(-int(count @ value) // (k * capacity)))
    return best


PLACED = "_item long, length long, party long, bin long, offset long, bins long, bound long"


def _placed(item: np.ndarray, length: np.ndarray, party, number, offset, bins, bound) -> pa.Table:
    full = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int64), item.shape))
    return pa.table([pa.array(item), pa.array(length), full(party), full(number), full(offset), full(bins), full(bound)], names=PLACED.replace(" long", "").split(", "))


def _by_item(table: pa.Table, *names: str) -> list[np.ndarray]:
    columns = [table.column(n).to_numpy() for n in names]
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def _pack(capacity: int) -> Callable:
    def run(key, table):
        item, length = _by_item(table, "_item", "length")
        number, offset, bins = best_fit_decreasing(length, capacity)
        return _placed(item, length, key[0].as_py(), number, offset, bins, lower_bound(length, capacity))

    return run


def _mixed(item: np.ndarray, seed: int) -> np.ndarray:
    h = (item.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)


def _exchange(capacity: int, seed: int) -> Callable:
    """Deal the pieces of sequences that are not full anew among the partitions of a group, and pack them again."""

    def run(key, table):
        item, length, party, number, offset, bins, bound = _by_item(table, "_item", "length", "party", "bin", "offset", "bins", "bound")
        parties, of = np.unique(party, return_inverse=True)
        _, which = np.unique(of * (int(number.max()) + 1) + number, return_inverse=True)
        filled = np.bincount(which, weights=length).astype(np.int64)
        free = filled[which] < capacity  # pieces that take part in the exchange
        before = int((filled < capacity).sum())
        deals = {1, len(parties)} if len(parties) > 1 else {1}  # one pool together, or as many partitions as before
        best = None
        for deal in sorted(deals):
            to = (_mixed(item[free], seed) % np.uint64(deal)).astype(np.int64)
            new_bin, new_offset, total = np.empty(len(to), np.int64), np.empty(len(to), np.int64), 0
            for p in range(deal):
                own = np.flatnonzero(to == p)
                b, o, n = best_fit_decreasing(length[free][own], capacity)
                new_bin[own], new_offset[own], total = b + total, o, total + n
            if best is None or total < best[0]:
                best = total, new_bin, new_offset
        total, new_bin, new_offset = best
        if total < before:
            kept = np.flatnonzero(~free)
            _, renamed = np.unique(which[kept], return_inverse=True)
            number[kept] = renamed
            start = int(renamed.max()) + 1 if len(kept) else 0
            number[free], offset[free] = start + new_bin, new_offset
            now = start + total
        else:
            number, now = which, len(filled)
        # The partitions of an exchange go on as one, with the bound of all their pieces.
        return _placed(item, length, int(parties[0]), number, offset, now, lower_bound(length, capacity))

    return run


def pack_items(items: DataFrame, capacity: int, per_partition: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """(_item, length, party, bin, offset, bins, bound) of pieces (_item, length); a bin is named by (party, bin).

    A partition that took part in an exchange goes on with its partners as one of up to ``FAN`` times the size, and
    no partition above ``FAN * FAN`` times ``per_partition`` exchanges again, which bounds a task.
    """
    count = items.count()
    parties = max(1, -(-count // per_partition))
    dealt = items.withColumn("_party", F.pmod(F.xxhash64("_item"), F.lit(parties)).cast("long"))
    current, settled = staged(dealt.groupBy("_party").applyInArrow(_pack(capacity), PLACED), "packed"), []
    for number in range(rounds):
        sizes = current.groupBy("party", "bins", "bound").agg(F.count("*").alias("n"))  # a row for each partition
        open_parties = sizes.filter((F.col("bins") > F.col("bound")) & (F.col("n") <= FAN * FAN * per_partition)).select("party")
        gaps = open_parties.count()
        if not gaps:
            break
        groups = -(-gaps // FAN)
        chosen = open_parties.select("party", F.pmod(F.xxhash64(F.lit(number), "party"), F.lit(groups)).cast("long").alias("_group"))
        settled.append(current.join(chosen.select("party"), "party", "left_anti").select(*current.columns))
        again = current.join(chosen, "party").groupBy("_group").applyInArrow(_exchange(capacity, number), PLACED)
        before = current.join(chosen.select("party"), "party", "left_semi").select("party", "bins").distinct().agg(F.sum("bins")).first()[0]
        current = staged(again, "packed")
        after = current.select("party", "bins").distinct().agg(F.sum("bins")).first()[0]
        if after >= before:
            break
    for part in settled:
        current = current.unionByName(part)
    return current


def pack(
    df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, carry: Sequence[str] = ("doc_id",), text: str = "text",
    per_partition: int = ITEMS,
) -> DataFrame:
    """The carried columns of every piece with its length, checksum, sequence and place in it.

    ``tokenizer`` is the JSON of a byte-level tokenizer.  ``certified`` says that the piece's partition needs no
    more sequences than its lower bound; whole sequences are certified by themselves.
    """
    pieces = staged(cut_documents(df, tokenizer, capacity, end_id, carry, text), "pieces")
    short = pieces.filter(F.col("length") < capacity).select("_item", "length")
    placed = pack_items(short, capacity, per_partition).select(
        "_item", F.shiftleft("party", 32).bitwiseOR(F.col("bin")).alias("_sequence"), "offset", (F.col("bins") == F.col("bound")).alias("_certified")
    )
    # Whole sequences take negative numbers, packed ones the numbers of their partition.
    found = pieces.join(placed, "_item", "left")
    whole = F.col("length") == capacity
    return found.select(
        *[c for c in pieces.columns if c != "_item"],
        F.when(whole, -1 - F.col("_item")).otherwise(F.col("_sequence")).alias("sequence_id"),
        F.when(whole, F.lit(0).cast("long")).otherwise(F.col("offset")).alias("offset"),
        F.coalesce("_certified", whole).alias("certified"),
    )
