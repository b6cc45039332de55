"""SimHash near-duplicates by Golay-code fuzzy hashing [op8].

A document's fingerprint has a bit set if more than half of the XXH64 values of its 4-word shingles have it.
Fingerprints link at four or fewer differing bits; a group is what links connect.

The 64 bits are cut into three segments of 22, 21 and 21 bits, read as words of the perfect Golay
code (23, 12).  ``near(s)`` is the set of codeword indices that a segment or a segment one bit away
decodes to: one index within two bits of a codeword, else at most six.  Two segments that differ in
at most two bits share an index, since both are within one bit of a word between them.  Pigeonhole on four
errors in three segments leaves two cases, and each gives keys that two linked fingerprints share:

* a segment has none and another at most two: the first exactly, an index of the second (6 kinds of key);
* the errors are 2, 1, 1: an index of the first, and from each of the others a half without error (12 kinds).

A fingerprint has about 95 keys of 33 bits and more, so unrelated ones rarely meet.  The fingerprints of a
key are not compared all with all.  First each is compared with the smallest of its key, and the links
found are contracted to components.  Only keys that still hold several components are looked at again:
the fingerprints outside the first component are joined with those of other components.  Keys where
even that is more than ``most_checks`` comparisons take another exact way: their fingerprints meet in every
word within two bits of them, and any two in one such word are linked.

Joins by key, word or fingerprint are sort-merge joins by a hint.  Spark takes the keys that a task makes for as
small as the fingerprints they come from, and staged rows for as small as their compressed files, and would collect them
on the driver to broadcast them.

* Null and empty texts have no words and fingerprint zero, which links like any other.
* Equal fingerprints are reduced to one before keys are made, so copies cost nothing more.
* Repeated rows come back as often as they come in.  Null ids take part but never name a group,
  unless it has no other ids; then its id is null.
* Texts that are not UTF-8 are hashed as the bytes they are.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.llm.blocks import BLOCK_BYTES, as_bytes, in_slices
from feedmill.llm.components import components
from feedmill.session import staged

WORDS = 4
SEED = 42
MAX_BITS = 4
MOST_CHECKS = 1 << 20
MARKS_PER_TASK = 8192

#: Segments of the fingerprint: (first bit, bits), and their halves.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HALVES = (((0, 11), (11, 11)), ((22, 11), (33, 10)), ((43, 11), (54, 10)))
#: A generator polynomial of the Golay code (fixed value).
GENERATOR = 0b110001110101


def word_lists(data: bytes, overlap: int, limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Lower-case words of a text in lists of bounded size; each list repeats the last ``overlap`` words."""
    carried: list[bytes] = []
    start, n = 0, len(data)
    while start < n:
        stop = start + limit
        while stop < n and data[stop] not in b" \t\n\v\f\r":
            stop += 1
        found = carried + data[start:stop].lower().split()
        if len(found) > len(carried):
            yield found
            carried = found[max(0, len(found) - overlap):] if overlap else []
        start = stop


def shingle_hashes(data: bytes, width: int = WORDS, limit: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included; one value of the whole sequence if it is shorter."""
    digest, made, last = xxhash.xxh64_intdigest, 0, None
    for words in word_lists(data, width - 1, limit):
        last = words
        if len(words) < width:
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - width + 1].tolist()
        ends = ends[width - 1 :].tolist()
        made += len(starts)
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    if not made and last:
        yield np.array([digest(b" ".join(last), SEED)], np.uint64)


def fingerprint(data: bytes, width: int = WORDS) -> int:
    total, counts = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(data, width):
        total += len(hashes)
        for at in range(0, len(hashes), 1 << 16):
            own = hashes[at : at + (1 << 16)]
            bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(len(own), 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little") if total else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, fingerprint as a signed long) of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in in_slices(batches, "text"):
            marks = np.array([fingerprint(t) for t in as_bytes(batch.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(marks, pa.int64())], names=["doc_id", "text_key", "fingerprint"]
            )

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, text_key long, fingerprint long")


class Golay:
    """Indices of the codewords near 23-bit words."""

    def __init__(self) -> None:
        rest = np.zeros(1 << 23, np.uint16)
        for bit in range(23):
            value = 1 << bit
            for high in range(22, 10, -1):
                if value >> high & 1:
                    value ^= GENERATOR << (high - 11)
            rest[1 << bit : 2 << bit] = rest[: 1 << bit] ^ np.uint16(value)
        self.rest = rest
        self.error = np.zeros(2048, np.uint32)
        bits = [1 << b for b in range(23)]
        for i, a in enumerate(bits):
            for j, b in enumerate(bits[i:], i):
                for c in bits[j:]:
                    pattern = a if a == b or b == c else a ^ b ^ c
                    pattern = a ^ c if (a == b) != (b == c) else pattern
                    self.error[rest[pattern]] = pattern

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.rest[words]]) >> np.uint32(11)

    def near(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of every different index of a word and its neighbours one bit away."""
        flips = np.array([0] + [1 << b for b in range(bits)], np.uint32)
        found = np.sort(self.index(words[:, None] ^ flips[None, :]), axis=1)
        fresh = np.ones(found.shape, bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        rows, columns = np.nonzero(fresh)
        return rows, found[rows, columns]


def _bits(marks: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    return (marks >> np.uint64(part[0])) & np.uint64((1 << part[1]) - 1)


def fuzzy_keys(marks: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys; any two fingerprints at most four bits apart share one."""
    rows_out, keys_out, kind = [], [], 0
    for y, (_, bits) in enumerate(SEGMENTS):
        rows, index = golay.near(_bits(marks, SEGMENTS[y]).astype(np.uint32), bits)
        index = index.astype(np.uint64)
        a, b = [s for s in range(3) if s != y]
        exact = [_bits(marks, SEGMENTS[a]), _bits(marks, SEGMENTS[b])]
        exact += [_bits(marks, p) | (_bits(marks, q) << np.uint64(11)) for p in HALVES[a] for q in HALVES[b]]
        for values in exact:
            rows_out.append(rows)
            keys_out.append((np.uint64(kind) << np.uint64(40)) | (values[rows] << np.uint64(12)) | index)
            kind += 1
    return np.concatenate(rows_out), np.concatenate(keys_out)


def _keyed(marks: DataFrame) -> DataFrame:
    """(key, fp) of all keys of the fingerprints."""

    def run(batches):
        golay = Golay()
        for batch in batches:
            all_marks = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_marks), 2048):
                own = all_marks[at : at + 2048]
                rows, keys = fuzzy_keys(own, golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own[rows].view(np.int64))], names=["key", "fp"])

    return marks.select("fp").mapInArrow(run, "key long, fp long")


def _ball(marks: DataFrame) -> DataFrame:
    """(word, fp): every fingerprint in all words within two bits of it."""
    single = [0] + [1 << b for b in range(64)]
    flips = np.array(sorted({a ^ b for a in single for b in single}), np.uint64)

    def run(batches):
        for batch in batches:
            for mark in batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64):
                words = (flips ^ mark).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.full(len(words), mark, np.uint64).view(np.int64))], names=["word", "fp"])

    return marks.select("fp").mapInArrow(run, "word long, fp long")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def groups(marks: DataFrame, most_checks: int = MOST_CHECKS) -> DataFrame:
    """(fp, label) of different fingerprints ``marks`` (fp); linked ones share a label."""
    tasks = marks.count() // MARKS_PER_TASK + 1  # a task makes about a hundred keys of each fingerprint
    keyed = _keyed(marks.select("fp").repartition(tasks))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("first")).filter("n > 1")
    members = staged(keyed.join(shared.hint("merge"), "key"), "members")
    star = members.filter((F.col("fp") != F.col("first")) & (_apart("fp", "first") <= MAX_BITS))
    labels = components(star.select(F.col("first").alias("u"), F.col("fp").alias("v")).distinct())

    known = labels.select(F.col("node").alias("fp"), "label")
    rest = members.filter("n > 2").select("key", "fp").join(known.hint("merge"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    rest = staged(rest, "rest")
    mixed = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo != hi")
    still = staged(rest.join(mixed.select("key", "lo", "n").hint("merge"), "key"), "still")
    outside = still.filter("label != lo")
    checks = outside.groupBy("key").agg(F.count("*").alias("m"), F.max("n").alias("n")).filter(F.col("m") * F.col("n") > most_checks)
    crowded = checks.select("key")
    x = outside.join(crowded.hint("merge"), "key", "left_anti").select("key", F.col("fp").alias("a"), F.col("label").alias("la"))
    y = still.select("key", F.col("fp").alias("b"), F.col("label").alias("lb"), "lo")
    near = (F.col("la") != F.col("lb")) & (_apart("a", "b") <= MAX_BITS) & ((F.col("lb") == F.col("lo")) | (F.col("a") < F.col("b")))
    links = x.join(y.hint("merge"), "key").filter(near).select(F.col("la").alias("u"), F.col("lb").alias("v")).distinct()

    ball = _ball(still.join(crowded.hint("merge"), "key", "left_semi").select("fp").distinct())
    least = ball.groupBy("word").agg(F.min("fp").alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = ball.join(least.hint("merge"), "word").filter("fp != first").select("fp", "first").distinct()
    own = known.select(F.col("fp").alias("first"), F.col("label").alias("lf"))
    met = met.join(known.hint("merge"), "fp", "left").join(own.hint("merge"), "first", "left")
    met = met.select(F.coalesce("label", "fp").alias("u"), F.coalesce("lf", "first").alias("v"))

    final = components(links.union(met)).select(F.col("node").alias("label"), F.col("label").alias("_final"))
    every = marks.select("fp").join(known.hint("merge"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    return every.join(final, "label", "left").select("fp", F.coalesce("_final", "label").alias("label"))


def membership(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_checks: int = MOST_CHECKS) -> DataFrame:
    """(doc_id, text_key, fingerprint, label, component_id) of every row; component_id is the group's smallest id."""
    marked = staged(fingerprints(docs, doc_id, text), "fingerprints")
    different = staged(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first_id")), "different")
    labels = staged(groups(different, most_checks), "groups")
    named = labels.join(different.hint("merge"), "fp").groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_mark = labels.join(named, "label").withColumnRenamed("fp", "fingerprint")
    return marked.join(by_mark, "fingerprint").select("doc_id", "text_key", "fingerprint", "label", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with all columns: the smallest id, and the smallest text key among repeated ids.

    How often a kept (id, text key) stands in ``docs`` is counted on slim rows, so whole rows move only to drop
    repeats of one (id, text).  Of such rows any one stays: they may differ in other columns.
    """
    found = staged(membership(docs, doc_id, text).select("doc_id", "text_key", "label"), "found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"))
    first = found.groupBy("label").agg(F.min(order).alias("_one")).select(F.col("_one.doc_id").alias("_doc"), F.col("_one.text_key").alias("_kept"))
    counts = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("_n"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_kept"))
    first = staged(first.distinct().join(counts.hint("merge"), same).select("_doc", "_kept", "_n"), "kept")
    own = [F.col(c).alias(f"_in{i}") for i, c in enumerate(docs.columns)]  # no column of the input can clash with the ones joined to it
    keyed = docs.select(*own, F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_kept"))
    single = keyed.join(first.filter("_n = 1"), same, "left_semi")
    repeated = keyed.join(first.filter("_n > 1"), same, "left_semi").dropDuplicates(["_id", "_key"])
    return single.unionByName(repeated).select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)])
