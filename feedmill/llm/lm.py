"""LM scoring by cross-entropy difference [op2].

Two 5-gram models over bytes, one of the target texts and one of the background (all scored documents),
share one vocabulary of 256 bytes and one smoothing: Witten-Bell with the uniform distribution,

    p(b | c) = (n(c, b) + t(c) / 256) / (n(c) + t(c)),     t(c): different bytes seen after c

and 1 / 256 after a context never seen.  Every byte of a text is a token; the context at the beginning of a
text is zero bytes.  A document's score is the mean over its tokens of target loss minus background
loss in nats, so texts like the target score low.

The target is either a table of texts or, with ``key``, a table of keys: then the texts of the rows of ``docs``
whose key it holds.  Those rows are found by their slim (chunk, row, key) and counted inside their chunks, so no text
moves to be selected.

Counts cover all texts.  Texts stay in compressed chunks of about 4 MB; each chunk sends its different
5-grams with their counts to the buckets of their contexts, where the counts of all chunks are summed, and gets
back one pair of losses per 5-gram.  What is sent grows with the number of chunks.  A bucket holds the
5-grams of its contexts once for each chunk, and the number of buckets follows the input.

* Null and empty texts have no tokens and zero losses.  Without target texts the target model is uniform.
* A null key selects nothing; a key that is repeated in the target selects its rows once.
* Repeated rows count as often as they occur.  All other columns come back as they are, without the text; one that
  is named like an added one is replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmill.llm.blocks import as_bytes, mix, packed_chunks, unpacked

ORDER = 5
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
PIECE = 1 << 20
#: In place of a chunk's number: counts of the target, which nobody asks back.
TARGET = -1

_COUNTS = "bucket int, chunk long, grams binary, counts binary"


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends in each byte of each text, as 40-bit numbers, and the texts' lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    pad = bytes(ORDER - 1)
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    out, at = np.empty(int(lengths.sum()), np.uint64), 0
    for start, size in zip((np.cumsum(lengths + ORDER - 1) - lengths).tolist(), lengths.tolist()):
        for a in range(start, start + size, PIECE):
            b = min(a + PIECE, start + size)
            code = np.zeros(b - a, np.uint64)
            for back in range(ORDER - 1, -1, -1):
                code = (code << np.uint64(8)) | data[a - back : b - back]
            out[at : at + b - a] = code
            at += b - a
    return out, lengths


def _dealt(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the 5-grams by (bucket of their context, 5-gram), and where each bucket begins."""
    bucket = mix(grams >> np.uint64(8)) % np.uint64(buckets)
    order = np.lexsort((grams, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def losses(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """-log p of sorted different 5-grams with their counts; contexts are complete."""
    context = grams >> np.uint64(8)
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    sizes = np.diff(np.append(first, len(grams)))
    total = np.repeat(np.add.reduceat(counts, first), sizes)
    types = np.repeat(np.add.reduceat((counts > 0).astype(np.int64), first), sizes)
    return -np.log(np.where(total > 0, (counts + types / 256) / np.maximum(total + types, 1), 1 / 256))


def _sum(table: pa.Table) -> pa.Table:
    """One bucket: both models' losses for what each chunk of the background has asked."""
    rows = table.to_pylist()
    parts = [np.frombuffer(r["grams"], "<u8") for r in rows]
    counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]).astype(np.int64)
    grams, which = np.unique(np.concatenate(parts), return_inverse=True)
    known = np.repeat([r["chunk"] >= 0 for r in rows], [len(p) for p in parts])
    own = [np.bincount(which[known == side], counts[known == side], len(grams)).astype(np.int64) for side in (False, True)]
    pair = np.stack([losses(grams, c) for c in own], axis=1).astype("<f4")
    edges = np.cumsum([0] + [len(p) for p in parts])
    out = [(r["bucket"], r["chunk"], pair[which[a:b]].tobytes()) for r, a, b in zip(rows, edges[:-1], edges[1:]) if r["chunk"] >= 0]
    columns = list(zip(*out)) or [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "chunk", "losses"])


def score(
    docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", bucket_bytes: int = BUCKET_BYTES, key: str | None = None
) -> DataFrame:
    """``docs`` without text but with n_tokens, target_loss, background_loss and score (means per token)."""
    added = [T.StructField("n_tokens", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in ("target_loss", "background_loss", "score")]
    names = {f.name for f in added} | {text}
    carried = [f for f in docs.schema.fields if f.name not in names]
    columns = [f.name for f in carried]
    total = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    buckets = max(32, -(-total // bucket_bytes))

    def counted(number: int, codes: np.ndarray):
        grams, times = np.unique(codes, return_counts=True)
        order, edges = _dealt(grams, buckets)
        rows = [
            (b, number, grams[own].astype("<u8").tobytes(), times[own].astype("<u4").tobytes())
            for b in range(buckets) if len(own := order[edges[b] : edges[b + 1]])
        ]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)], names=["bucket", "chunk", "grams", "counts"])

    def count(asked: bool):
        def run(batches):
            for batch in batches:
                for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield counted(number if asked else TARGET, _codes(as_bytes(unpacked(blob).column(0).combine_chunks()))[0])

        return run

    def keys(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = unpacked(blob).column(1 + columns.index(key)).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), number)), pa.array(np.arange(len(own), dtype=np.int32)), own], names=["chunk", "row", "key"]
                )

    def count_both(rows: pa.Table, chosen: pa.Table) -> pa.Table:
        codes, lengths = _codes(as_bytes(unpacked(rows["blob"][0].as_py()).column(0).combine_chunks()))
        taken = np.zeros(len(lengths), bool)
        taken[chosen["row"].to_numpy()] = True
        return pa.Table.from_batches([counted(rows["chunk"][0].as_py(), codes), counted(TARGET, codes[np.repeat(taken, lengths)])])

    def last(rows: pa.Table, answers: pa.Table) -> pa.Table:
        table = unpacked(rows["blob"][0].as_py())
        codes, lengths = _codes(as_bytes(table.column(0).combine_chunks()))
        grams, which = np.unique(codes, return_inverse=True)
        order, edges = _dealt(grams, buckets)
        replies = dict(zip(answers["bucket"].to_pylist(), answers["losses"].to_pylist()))
        pair = np.zeros((len(grams), 2))
        for b in range(buckets):
            if edges[b] < edges[b + 1]:
                pair[order[edges[b] : edges[b + 1]]] = np.frombuffer(replies[b], "<f4").reshape(-1, 2)
        sums = np.zeros((len(lengths), 2))
        some = np.flatnonzero(lengths)
        if len(some):
            sums[some] = np.add.reduceat(pair[which], (np.cumsum(lengths) - lengths)[some], axis=0)
        mean = sums / np.maximum(lengths, 1)[:, None]
        out = [pa.array(lengths), pa.array(mean[:, 0]), pa.array(mean[:, 1]), pa.array(mean[:, 0] - mean[:, 1])]
        return pa.table([table.column(c) for c in columns] + out, names=columns + [f.name for f in added])

    packed = packed_chunks(docs.select(text, *columns), text, CHUNK_BYTES).repartition("chunk")
    if key is None:
        wanted = packed_chunks(target.select(target_text), target_text, CHUNK_BYTES).mapInArrow(count(False), _COUNTS)
        counts = packed.mapInArrow(count(True), _COUNTS).union(wanted)
    else:
        kind = docs.schema[key].dataType.simpleString()
        listed = packed.mapInArrow(keys, f"chunk long, row int, key {kind}")
        chosen = listed.join(target.select(F.col(key).alias("key")), "key", "left_semi").select("chunk", "row")
        counts = packed.groupBy("chunk").cogroup(chosen.groupBy("chunk")).applyInArrow(count_both, _COUNTS)
    answers = counts.groupBy("bucket").applyInArrow(_sum, "bucket int, chunk long, losses binary")
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(last, T.StructType(carried + added))
