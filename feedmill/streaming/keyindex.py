"""An index of stored keys that a batch asks without reading them all [T7, D1].

Keys are dealt to buckets by hash and lie in segments: every batch adds one, and when ``FAN`` segments of one level have
gathered they are merged into one of the next level, so there are few segments and a key is rewritten once per level.
Each bucket of a segment has a Bloom filter.  A batch tests its keys against the filters, and only the buckets
where one may be held are opened and compared exactly; new keys open next to nothing, whatever is stored.

A manifest names the segments that count (see ``snapshots``).  Segments carry the number of the last batch they hold, and a
batch sees those of earlier batches only, so a repeated batch finds what it found before.  Work outside the stream has
numbers from -1 downwards and sees all segments but its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedmill.session import staged
from feedmill.streaming.snapshots import Folder, Manifests

#: Buckets of a new index; an existing one keeps its number, which its manifest holds.
BUCKETS = 32
FAN = 8
BITS_PER_KEY = 16
HASHES = 8

_FILTERS = "bucket int, bits binary"


def _places(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """Bit positions of keys, a row each, by double hashing."""
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((one[:, None] + steps * (two | np.uint64(1))[:, None]) & np.uint64(size - 1)).astype(np.int64)


def _hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table.column(n).to_numpy().view(np.uint64) for n in ("one", "two"))


def _make_filter(key, keys):
    one, two = _hashes(keys)
    size = 1 << max(10, (BITS_PER_KEY * len(one) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[_places(one, two, size).ravel()] = True
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bucket", "bits"])


def _test_filters(key, keys, filters):
    """The segments of a bucket whose filter takes one of the keys."""
    found = []
    if len(keys):
        one, two = _hashes(keys)
        for segment, bits in zip(filters.column("segment").to_pylist(), filters.column("bits").to_pylist()):
            held = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
            if held[_places(one, two, len(held))].all(axis=1).any():
                found.append(segment)
    return pa.table([pa.array(found, pa.string()), pa.array([key[0].as_py()] * len(found), pa.int32())], names=["segment", "bucket"])


@dataclass
class KeyIndex:
    """Stored keys below ``path``; a key is one column or several, compared as one text."""

    path: str
    keys: list[str]
    buckets: int = BUCKETS
    fan: int = FAN
    opened: list[tuple[str, int]] = field(default_factory=list)  # (segment, bucket) of the last question

    def _key(self) -> Column:
        """All key columns in one text; null is a value of its own."""
        return F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(self.keys)]))

    def _hashed(self, rows: DataFrame) -> DataFrame:
        slim = rows.select(self._key().alias("key"))
        return slim.select(
            "key", F.xxhash64("key").alias("one"), F.xxhash64(F.lit("second"), "key").alias("two"),
            F.pmod(F.hash("key"), F.lit(self.buckets)).alias("bucket"),
        )

    def _segments(self, spark: SparkSession, before: int | None) -> list[dict]:
        manifest = Manifests(spark, self.path).newest()
        if manifest is None:
            return []
        self.buckets = manifest["buckets"]
        return [s for s in manifest["segments"] if before is None or s["upto"] < before or before < 0 and s["upto"] != before]

    def _publish(self, spark: SparkSession, segments: list[dict]) -> None:
        Manifests(spark, self.path).publish({"buckets": self.buckets, "segments": segments})

    def _read(self, spark: SparkSession, what: str, names: list[str], schema: str) -> DataFrame:
        path = f"{self.path}/{what}"
        try:
            table = spark.read.schema(f"{schema}, segment string").option("basePath", path).parquet(*[f"{path}/segment={n}" for n in names])
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            table = spark.createDataFrame([], f"{schema}, segment string")
        return table

    def _write(self, hashed: DataFrame, name: str) -> None:
        hashed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/keys/segment={name}")
        stored = self._read(hashed.sparkSession, "keys", [name], "key string, one long, two long, bucket int")
        filters = stored.select("bucket", "one", "two").groupBy("bucket").applyInArrow(_make_filter, _FILTERS)
        filters.write.parquet(f"{self.path}/filters/segment={name}")

    def absent(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The rows whose key no segment (of batches before ``before``) holds [J9]."""
        spark = rows.sparkSession
        segments = [s["name"] for s in self._segments(spark, before)]
        self.opened = []
        if not segments:
            return rows
        asked = staged(self._hashed(rows).distinct(), "asked")
        filters = self._read(spark, "filters", segments, _FILTERS)
        maybe = asked.select("bucket", "one", "two").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_test_filters, "segment string, bucket int")
        self.opened = [(r.segment, r.bucket) for r in maybe.collect()]  # at most a row for each bucket of each segment
        if not self.opened:
            return rows
        by_segment: dict[str, list[int]] = {}
        for segment, bucket in self.opened:
            by_segment.setdefault(segment, []).append(bucket)
        chosen = F.lit(False)
        for segment, buckets in by_segment.items():
            chosen = chosen | ((F.col("segment") == segment) & F.col("bucket").isin(buckets))
        stored = self._read(spark, "keys", sorted(by_segment), "key string, bucket int").filter(chosen).select(F.col("key").alias("_held"))
        return rows.withColumn("_key", self._key()).join(stored, F.col("_key") == F.col("_held"), "left_anti").drop("_key")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """The new keys of a batch as a segment, in place of an earlier try of the same batch."""
        spark = rows.sparkSession
        name = f"{batch_id}-{uuid.uuid4().hex[:8]}"
        held = [s for s in self._segments(spark, None) if s["upto"] != batch_id or s["level"]]
        hashed = self._hashed(rows).distinct()
        if hashed.isEmpty():
            self._publish(spark, held)
            return
        self._write(hashed, name)
        self._publish(spark, [*held, {"name": name, "level": 0, "upto": batch_id}])

    def merge(self, spark: SparkSession, before: int) -> None:
        """Merge full levels of segments of batches before ``before``, which will not be repeated."""
        while True:
            held = self._segments(spark, None)
            last = min([s["upto"] for s in held if not s["level"]], default=0)  # if negative, it may yet be repeated
            ready = {}
            for s in held:
                if s["upto"] < before and not (s["upto"] == last < 0):
                    ready.setdefault(s["level"], []).append(s)
            full = [level for level, own in sorted(ready.items()) if len(own) >= self.fan]
            if not full:
                break
            own = ready[full[0]]
            name = f"merged-{uuid.uuid4().hex[:12]}"
            self._write(self._read(spark, "keys", [s["name"] for s in own], "key string, one long, two long, bucket int").drop("segment"), name)
            names = {s["name"] for s in own}
            merged = {"name": name, "level": full[0] + 1, "upto": max(s["upto"] for s in own)}
            self._publish(spark, [merged, *[s for s in held if s["name"] not in names]])
        self._clean(spark)

    def _clean(self, spark: SparkSession) -> None:
        manifests = Manifests(spark, self.path)
        named = {s["name"] for m in (manifests.newest(), manifests.newest(1)) if m for s in m["segments"]}
        for what in ("keys", "filters"):
            folder = Folder(spark, f"{self.path}/{what}")
            for name in folder.names():
                if name.startswith("segment=") and name.split("=")[1] not in named:
                    folder.remove(name)
