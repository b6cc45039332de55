"""Quality classifier by positive-unlabelled learning [op3].

A linear model on the shape of a text is fitted by the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with logistic losses: trusted positives are labelled rows, the unlabelled are any documents, and the class
prior is estimated as the share of positives among all labelled rows.  Where the second part turns
negative its gradient is followed upwards, so that the model cannot explain the unlabelled away.
The score is the model's probability of the positive class.

Learning takes at most ``MOST_EXAMPLES`` positives and as many unlabelled documents, chosen by a hash of
their id, and only from rows outside the held-out fold (crc32 of the id as text, modulo 5, is 0).  The
prior covers all labels of the other folds, and every whole text is scored.

Inputs are the text's bytes alone: shares of single ASCII punctuation marks, of three-character patterns of
byte classes, of repeated neighbours, words and lines, and the mean word length.

* Null and empty texts have all-zero shares and are scored like any other text.
* A label given several times counts by its mean; ids without text, or null, teach nothing.  Of an id with several texts the
  one with the smallest hash teaches.
* Without positives the score is the constant 0.5.
* Repeated rows come back as often as they come in, with all other columns; a column that is named like an
  added one is replaced.  A null id is not held out.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmill.llm.blocks import as_bytes, in_slices

MOST_EXAMPLES = 10_000
FOLDS = 5
THRESHOLD = 0.3
STEPS = 400
PIECE = 1 << 20

_PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])


def _classes() -> np.ndarray:
    """Eight classes of bytes: other, upper, lower, digit, blank, line end, punctuation, beyond ASCII."""
    table = np.zeros(256, np.uint16)
    for b in range(256):
        c = chr(b)
        table[b] = 7 if b > 127 else 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 4 if c in " \t" else 5 if c in "\r\n" else 0
    table[_PUNCTUATION] = 6
    return table


CLASSES = _classes()
DIMENSION = 512 + len(_PUNCTUATION) + 5


def _pieces(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        stop = start + PIECE
        while stop < len(data) and data[stop] > 32:
            stop += 1
        yield data[start:stop]
        start = stop


def features(data: bytes) -> np.ndarray:
    out = np.zeros(DIMENSION, np.float32)
    if not data:
        return out
    marks, patterns = np.zeros(256, np.int64), np.zeros(512, np.int64)
    seen: set[bytes] = set()
    lines: set[bytes] = set()
    words = same = letters = line_count = 0
    last = b""
    for piece in _pieces(data):
        raw = np.frombuffer(piece, np.uint8)
        marks += np.bincount(raw, minlength=256)
        kinds = CLASSES[raw]
        patterns += np.bincount(kinds[:-2] * 64 + kinds[1:-1] * 8 + kinds[2:], minlength=512)[:512]
        own = piece.split()
        if own:
            same += sum(map(bytes.__eq__, own, [last] + own[:-1]))
            last = own[-1]
        words += len(own)
        letters += sum(map(len, own))
        seen.update(own)
        rows = piece.split(b"\n")
        line_count += len(rows)
        lines.update(rows)
    out[:512] = patterns / max(1, patterns.sum())
    out[512:-5] = marks[_PUNCTUATION] / len(data)
    many = max(1, words)
    out[-5:] = same / many, 1 - len(seen) / many, 1 - len(lines) / line_count, min(1, letters / many / 40), min(1, 10 / (words + 10))
    return np.sqrt(out)


@dataclass(frozen=True)
class Model:
    """A linear model; ``weights`` is None if nothing could be learned."""

    prior: float
    weights: np.ndarray | None = None
    bias: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return _sigmoid(x @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_risk(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk by Adam over all examples, which are kept in single precision."""
    if not len(positives) or not len(unlabelled):
        return Model(prior)
    many = len(positives) + len(unlabelled)
    mean = (positives.sum(axis=0, dtype=np.float64) + unlabelled.sum(axis=0, dtype=np.float64)) / many
    squares = sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in (positives, unlabelled)) / many
    scale = np.sqrt(np.maximum(squares - mean**2, 0))
    scale = np.where(scale > 1e-6, scale, np.inf)

    def scaled(x: np.ndarray) -> np.ndarray:
        out = x.astype(np.float32)
        out -= mean.astype(np.float32)
        out /= scale.astype(np.float32)
        return out

    p, u = scaled(positives), scaled(unlabelled)
    w, b = np.zeros(len(mean)), 0.0
    m = v = np.zeros(len(mean) + 1)
    for step in range(1, steps + 1):
        sp, su = (_sigmoid(x @ w.astype(np.float32) + b).astype(np.float32) for x in (p, u))
        risk = np.mean(-np.log(np.maximum(1 - su, 1e-12))) - prior * np.mean(-np.log(np.maximum(1 - sp, 1e-12)))
        rest = np.append(su @ u, su.sum()) / len(u) - prior * np.append(sp @ p, sp.sum()) / len(p)
        if risk < 0:
            gradient = -rest
        else:
            gradient = prior * np.append((sp - 1) @ p, (sp - 1).sum()) / len(p) + rest
        gradient[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(prior, w / scale, float(b - (w / scale) @ mean))


def held_out(doc_id: Column) -> Column:
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = MOST_EXAMPLES) -> Model:
    """Learn from the folds that are not held out."""
    key = F.col("_id")
    given = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).filter(key.isNotNull() & F.col("_y").isNotNull() & ~held_out(key))
    given = given.groupBy("_id").agg((F.avg("_y") >= 0.5).alias("_good"))
    prior = given.agg(F.avg(F.col("_good").cast("double"))).head()[0]
    if not prior:
        return Model(0.5)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    good = given.filter("_good").orderBy(F.xxhash64(F.lit(1), key), key).limit(most).select(key, F.lit(True).alias("_good"))
    some = rows.select(key).filter(key.isNotNull() & ~held_out(key)).distinct().orderBy(F.xxhash64(F.lit(2), key), key).limit(most)
    chosen = good.union(some.select(key, F.lit(False).alias("_good")))
    met = rows.filter(F.col("_text").isNotNull()).join(F.broadcast(chosen), "_id")  # 2 * most ids at most, so no text is shuffled to be chosen
    first = F.min(F.struct(F.xxhash64("_text"), "_text")).alias("_least")
    texts = met.groupBy("_id", "_good").agg(first).select(F.col("_least._text").alias("_text"), "_good")

    def run(batches):
        for batch in in_slices(batches, "_text"):
            x = [features(t).tobytes() for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], names=["x", "good"])

    found = texts.select("_text", "_good").mapInArrow(run, "x binary, good boolean").toArrow()  # 2 * most rows at most
    known = found["good"].to_numpy()
    x, at = np.empty((len(known), DIMENSION), np.float32), 0
    for value in found["x"]:
        x[at] = np.frombuffer(value.as_buffer(), np.float32)
        at += 1
    del found
    positives, unlabelled = x[known], x[~known]
    del x
    return fit_risk(positives, unlabelled, float(np.clip(prior, 0.01, 0.99)))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row with score and predicted (1 from ``threshold`` on)."""
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]

    def run(batches):
        for batch in in_slices(batches, text):
            x = np.array([features(t) for t in as_bytes(batch.column(batch.schema.get_field_index(text)))], np.float64).reshape(-1, DIMENSION)
            s = model.scores(x)
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(own + [pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=names + ["score", "predicted"])

    return docs.mapInArrow(run, T.StructType(kept + added))
