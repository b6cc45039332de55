"""Byte-level BPE: encoding by a hierarchical-bitmap rank queue, and decoding [op1].

``encode`` adds ``ids`` (token ids as little-endian unsigned 32-bit integers, one after another) and
``n_tokens``; ``decode`` adds ``decoded`` (the bytes of the ids); ``round_trip`` does both.  They work row by row inside Arrow
batches, so there is no shuffle and a lost executor costs one partition.

* Each match of the pattern (a pre-token) is encoded separately; special tokens are ordinary text.
* A null or empty text has no ids and decodes to empty bytes; null ids decode to empty bytes.
* Bytes that are not UTF-8 become the replacement character before encoding.
* Repeated rows, and all other columns, are kept as they are; a column that is named like an added
  one is replaced.
* A text is never cut inside a pre-token.  Texts of any length are worked off in pieces of bounded size, cut where the
  pattern forces a start, with or without spaces.  A pre-token of n bytes takes O(n) queue steps and memory; only one of
  many megabytes (a run of one kind of character) needs more than a piece.
"""

from __future__ import annotations

import base64
from bisect import insort
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from feedmill.llm.blocks import BLOCK_BYTES, RangeHash, as_bytes, blocks, gather, in_slices

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3

#: Pre-tokens remembered per task; the memory is cleared when it is full.
REMEMBERED = 3 << 17
#: Bytes of texts, or of ids, that a task holds unpacked at a time.
SLICE_BYTES = 2 << 20

IDS = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
DECODED = [T.StructField("decoded", T.BinaryType())]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (one base64 token and its rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merger:
    """Encodes one pre-token at a time by a queue of merges; the queue is empty between calls.

    A bucket per rank holds positions of the linked list of parts.  A two-level bitmap marks the ranks with
    buckets: ``words`` has 256 ranks in each word, and a bit of ``top`` marks each word in use, so finding
    the first set bit on both levels gives the lowest rank in constant time.  A bucket hands out its
    leftmost position first.  Entries are not removed when a neighbour merges; positions whose pair has
    changed since are skipped when they are read.  (The loops are written out for speed.)
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((max(ranks.values()) >> 8) + 1)
        self.bits = [1 << k for k in range(max(256, len(self.words)))]

    def encode(self, piece: bytes) -> list[int]:
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, top, buckets, words, bits = len(piece), 0, self.buckets, self.words, self.bits
        # Part i is piece[i:end[i]]; it is alive while end[i] > 0, and previous[i] starts the part before it.
        end, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    top |= bits[rank >> 8]
                    words[rank >> 8] |= bits[rank & 255]
        while top:
            word = (top & -top).bit_length() - 1
            used = words[word]
            rank = (word << 8) + (used & -used).bit_length() - 1
            words[word] = used = used & (used - 1)
            if not used:
                top ^= bits[word]
            bucket, at, lower = buckets.pop(rank), 0, False
            while at < len(bucket):
                if lower:  # a merge made a pair of lower rank: put the rest back
                    buckets[rank] = bucket[at:]
                    top |= bits[rank >> 8]
                    words[rank >> 8] |= bits[rank & 255]
                    break
                i = bucket[at]
                at += 1
                middle = end[i]
                if not middle or middle == n or get(piece[i : end[middle]]) != rank:
                    continue  # stale: a side of this pair has merged with something else
                last = end[i] = end[middle]
                end[middle] = 0
                new = []
                if last < n:
                    previous[last] = i
                    new.append((get(piece[i : end[last]]), i))
                left = previous[i]
                if left >= 0:
                    new.append((get(piece[left:last]), left))
                for made, where in new:
                    if made is None:
                        continue
                    if made in buckets:
                        insort(buckets[made], where)
                    else:
                        buckets[made] = [where]
                        top |= bits[made >> 8]
                        words[made >> 8] |= bits[made & 255]
                    lower = lower or made < rank
        ids, i = [], 0
        while i < n:
            ids.append(get(piece[i : end[i]]))
            i = end[i]
        return ids


def character_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text, table = "".join(map(chr, points)), np.full(0x110000, OTHER, np.uint8)
    where = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, text):
            table[where[run.start() : run.end()]] = kind
    return table


def pretoken_starts(points: np.ndarray, text_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts that lie one after another begin, as indices of code points.

    The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` as
    rules on runs of one class: the last space before a run belongs to the run, white space before
    it is one pre-token, and a lone apostrophe takes the letters of its contraction.
    """
    n = len(points)
    kind = classes[points]
    run = np.empty(n + 1, bool)
    run[0] = run[n] = True
    run[1:n] = kind[1:] != kind[:-1]
    run[text_starts] = True
    text_end = np.zeros(n + 1, bool)
    text_end[text_starts] = text_end[n] = True
    starts = run.copy()
    edges = np.flatnonzero(run)
    after = edges[1:][(kind[edges[:-1]] == SPACE) & ~text_end[edges[1:]]]  # ends of white space inside a text
    starts[after - 1] = True
    starts[after[points[after - 1] == 0x20]] = False
    at = np.flatnonzero((points == 0x27) & starts[:n])
    at = at[at + 1 < n]
    at = at[run[at + 1] & ~text_end[at + 1] & (kind[at + 1] == LETTER)]
    first = points[at + 1]
    second = np.where((at + 2 < n) & ~run[np.minimum(at + 2, n)], points[np.minimum(at + 2, n - 1)], 0)
    one = np.isin(first, [ord(c) for c in "stmd"])
    two = np.zeros(len(at), bool)
    for pair in ("re", "ve", "ll"):
        two |= (first == ord(pair[0])) & (second == ord(pair[1]))
    taken = one | two
    at, length = at[taken], 1 + one[taken] * 1 + (~one[taken]) * 2
    starts[at + 1] = False
    starts[at + length] = True
    return np.flatnonzero(starts[:n])


#: Places where two pre-tokens always meet: before white space, and between a letter, a number and anything else, but not
#: after an apostrophe, which may begin a contraction.
_CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def pieces(text: str, limit: int = BLOCK_BYTES // 2) -> Iterator[str]:
    """A text cut only where pre-tokens meet, after about ``limit`` characters each."""
    start = 0
    while len(text) - start > limit:
        cut = _CUT.search(text, start + limit)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Encoder:
    """Ids of many texts at once; every distinct pre-token of a block is merged once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merger, self.classes, self.hash = Merger(ranks), character_classes(), RangeHash()
        self.known: dict[bytes, bytes] = {}

    def _ids(self, piece: bytes) -> bytes:
        """Packed ids, which take half the memory of a list."""
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            own = self.merger.encode(piece)
            ids = pack(f"<{len(own)}I", *own)
            if len(piece) < 64:
                self.known[piece] = ids
        return ids

    def _alike(self, data: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(examples, the example of each pre-token) of pre-tokens that lie one after another.

        Pre-tokens with one name are compared by their bytes; those that differ become examples of their own.
        """
        self.hash.load(data)
        _, example, which = np.unique(self.hash.names(begin, finish), return_index=True, return_inverse=True)
        lengths, first = finish - begin, example[which]
        same = lengths == lengths[first]
        alike = np.flatnonzero(same)
        own = data if same.all() else gather(data, begin[alike], lengths[alike])
        equal = own == gather(data, begin[first[alike]], lengths[alike])
        if not equal.all():
            same[np.repeat(alike, lengths[alike])[~equal]] = False
        other = np.flatnonzero(~same)
        which[other] = len(example) + np.arange(len(other))
        return np.append(example, other), which

    def block(self, texts: list[str]) -> list[bytes]:
        sizes = np.array([len(t) for t in texts])
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        text_starts = np.cumsum(sizes) - sizes
        starts = pretoken_starts(points, text_starts[sizes > 0], self.classes)
        data = joined.encode()
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offset = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offset[1:])
        begin = offset[starts]
        finish = np.append(begin[1:], len(data))
        example, which = self._alike(np.frombuffer(data, np.uint8), begin, finish)
        found = [self._ids(data[b:e]) for b, e in zip(begin[example].tolist(), finish[example].tolist())]
        lengths = np.array([len(f) for f in found]) // 4
        token_lengths = lengths[which]
        flat = np.frombuffer(b"".join(found), "<u4")
        ids = gather(flat, (np.cumsum(lengths) - lengths)[which], token_lengths).astype("<u4").tobytes()
        before = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(token_lengths, out=before[1:])
        edges = 4 * before[np.searchsorted(starts, np.append(text_starts, len(points)))]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def many(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(index, ids) of every text in order."""
        for part in blocks([len(t) for t in texts], BLOCK_BYTES // 2):
            own = texts[part]
            if len(own) == 1:
                yield part.start, b"".join(self.block([p])[0] for p in pieces(own[0]))
            else:
                yield from enumerate(self.block(own), part.start)


def _with_columns(df: DataFrame, added: list[T.StructField]) -> tuple[list[str], T.StructType]:
    names = [f.name for f in added]
    kept = [f for f in df.schema.fields if f.name not in names]
    return [f.name for f in kept], T.StructType(kept + added)


def _batches(batch: pa.RecordBatch, kept: list[str], sizes: list[int], columns) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of bounded size, with more columns."""
    for part in blocks(sizes, 4 * BLOCK_BYTES):
        rows = batch.slice(part.start, part.stop - part.start)
        yield pa.RecordBatch.from_arrays(
            [rows.column(rows.schema.get_field_index(c)) for c in kept] + [make(part) for _, make in columns],
            names=kept + [name for name, _ in columns],
        )


def _encoding(shared: Broadcast, kept: list[str], text: str) -> Callable:
    def run(batches):
        encoder = Encoder(shared.value)
        for batch in in_slices(batches, text, SLICE_BYTES):
            column = batch.column(batch.schema.get_field_index(text))
            texts = [t.decode("utf-8", "replace") for t in as_bytes(column)]
            ids = [found for _, found in encoder.many(texts)]
            yield from _batches(
                batch, kept, [len(t) + len(i) for t, i in zip(texts, ids)],
                [
                    ("ids", lambda part: pa.array(ids[part], pa.binary())),
                    ("n_tokens", lambda part: pa.array([len(i) // 4 for i in ids[part]], pa.int64())),
                ],
            )

    return run


def _decoding(shared: Broadcast, kept: list[str], ids: str) -> Callable:
    def run(batches):
        tokens = sorted((rank, token) for token, rank in shared.value.items())
        lengths = np.full(tokens[-1][0] + 1, -1, np.int64)
        lengths[[rank for rank, _ in tokens]] = [len(token) for _, token in tokens]
        starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        flat = np.frombuffer(b"".join(token for _, token in tokens), np.uint8)

        def text_of(packed: bytes) -> bytes:
            out = []
            for at in range(0, len(packed), BLOCK_BYTES):
                own = np.frombuffer(packed[at : at + BLOCK_BYTES], "<u4")
                if own.size and (own.max() >= len(lengths) or lengths[own].min() < 0):
                    raise ValueError("an id is not in the vocabulary")
                out.append(gather(flat, starts[own], lengths[own]).tobytes())
            return b"".join(out)

        for batch in in_slices(batches, ids, SLICE_BYTES):
            packed = as_bytes(batch.column(batch.schema.get_field_index(ids)))
            yield from _batches(
                batch, kept, [3 * len(p) for p in packed],
                [("decoded", lambda part: pa.array([text_of(p) for p in packed[part]], pa.binary()))],
            )

    return run


def _shared(df: DataFrame, ranks: dict[bytes, int]) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: its size does not depend on the data


def encode(df: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """Every row with the ids of its text."""
    kept, schema = _with_columns(df, IDS)
    return df.mapInArrow(_encoding(_shared(df, ranks), kept, text), schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """Every row with the bytes of its ids.  An id that the ranks do not have is an error."""
    kept, schema = _with_columns(df, DECODED)
    return df.mapInArrow(_decoding(_shared(df, ranks), kept, ids), schema)


def round_trip(df: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """Every row, without its text, with its ids and the bytes that those decode to.

    The same as ``encode`` and then ``decode``, in one Python worker for each task instead of two.
    """
    shared = _shared(df, ranks)
    names = {f.name for f in IDS + DECODED} | {text}
    carried = [f for f in df.schema.fields if f.name not in names]
    kept = [f.name for f in carried]
    encoding, decoding = _encoding(shared, kept, text), _decoding(shared, kept + [f.name for f in IDS], "ids")
    return df.mapInArrow(lambda batches: decoding(encoding(batches)), T.StructType(carried + IDS + DECODED))
