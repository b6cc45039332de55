"""Keyed tables of a snapshot and newer deltas, with a manifest that says which of them count [T2, D4].

Every micro-batch writes the keys it changed as a delta.  ``compact`` folds the snapshot and the deltas into a new snapshot
and then publishes a manifest that names it; readers take the newest manifest, its snapshot and the deltas after
it.  A compaction that is interrupted leaves files no manifest names, so the old state stands, and the next
one removes them.  What the manifest before the newest names is kept for readers that started on it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedmill.streaming.batches import read_batches, write_batch


class Folder:
    """A folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def names(self, name: str = "") -> list[str]:
        system, where = self._at(name)
        return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []

    def read(self, name: str) -> str:
        system, where = self._at(name)
        stream = system.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file under another name and rename it, so that it is seen whole or not at all."""
        system, draft = self._at(f"_draft-{uuid.uuid4().hex}")
        stream = system.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, where = self._at(name)
        if not system.rename(draft, where):
            raise OSError(f"{where} was not published")

    def remove(self, name: str) -> None:
        system, where = self._at(name)
        system.delete(where, True)


class Manifests:
    """Numbered manifests below a folder; the newest one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, f"{path}/manifests")

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names() if n.isdigit())

    def newest(self, back: int = 0) -> dict | None:
        numbers = self._numbers()
        return json.loads(self.folder.read(str(numbers[-1 - back]))) if len(numbers) > back else None

    def publish(self, content: dict) -> None:
        numbers = self._numbers()
        self.folder.publish(str(numbers[-1] + 1 if numbers else 0), json.dumps(content))
        for old in numbers[:-1]:  # the one before the newest stays
            self.folder.remove(str(old))


@dataclass(frozen=True)
class KeyedTable:
    """Rows by key; newer rows replace older ones, or add to them where ``sums`` is set."""

    path: str
    schema: T.StructType
    key: str
    sums: bool = False

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The changed keys of one batch; a repeated batch replaces its own delta."""
        write_batch(rows.select(*self.schema.names), f"{self.path}/deltas", batch_id)

    def _snapshot(self, spark: SparkSession, manifest: dict) -> DataFrame:
        columns = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])
        return spark.read.schema(columns).parquet(f"{self.path}/snapshots/{manifest['snapshot']}")

    def _layers(self, spark: SparkSession, before: int | None) -> DataFrame:
        manifest = Manifests(spark, self.path).newest()
        deltas = read_batches(spark, f"{self.path}/deltas", self.schema, before)
        if manifest is None:
            return deltas
        if before is not None and before <= manifest["upto"]:
            raise ValueError(f"batch {before} is older than the snapshot")
        return self._snapshot(spark, manifest).unionByName(deltas.filter(F.col("batch_id") > manifest["upto"]))

    def _folded(self, layers: DataFrame) -> DataFrame:
        """One row per key with the newest batch it comes from; partial aggregates, so no key gathers."""
        fields = [n for n in self.schema.names if n != self.key]
        if self.sums:
            found: list[Column] = [F.sum(n).alias(n) for n in fields]
            return layers.groupBy(self.key).agg(*found, F.max("batch_id").alias("batch_id"))
        latest = F.max_by(F.struct(*fields), "batch_id").alias("_latest")
        return layers.groupBy(self.key).agg(latest, F.max("batch_id").alias("batch_id")).select(self.key, "_latest.*", "batch_id")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The current row of every key, or as it was before a batch."""
        return self._folded(self._layers(spark, before)).select(*self.schema.names)

    def pending(self, spark: SparkSession) -> int:
        """Deltas that no snapshot holds."""
        manifest = Manifests(spark, self.path).newest()
        return len(self._deltas(spark, after=-1 if manifest is None else manifest["upto"]))

    def _deltas(self, spark: SparkSession, after: int) -> list[int]:
        numbers = [int(n.split("=")[1]) for n in Folder(spark, f"{self.path}/deltas").names() if n.startswith("batch_id=")]
        return [n for n in numbers if n > after]

    def compact(self, spark: SparkSession, before: int | None = None) -> None:
        """Fold the deltas (of batches before ``before``, which will not be repeated) into a new snapshot."""
        manifests = Manifests(spark, self.path)
        old = manifests.newest()
        taken = [n for n in self._deltas(spark, -1 if old is None else old["upto"]) if before is None or n < before]
        if not taken:
            return
        upto, name = max(taken), uuid.uuid4().hex
        self._folded(self._layers(spark, upto + 1)).write.parquet(f"{self.path}/snapshots/{name}")
        manifests.publish({"snapshot": name, "upto": upto})
        self._clean(spark, manifests)

    def _clean(self, spark: SparkSession, manifests: Manifests) -> None:
        """Remove what neither the newest manifest nor the one before it needs."""
        kept = [m for m in (manifests.newest(), manifests.newest(1)) if m is not None]
        named = {m["snapshot"] for m in kept}
        for name in Folder(spark, f"{self.path}/snapshots").names():
            if name not in named:
                Folder(spark, f"{self.path}/snapshots").remove(name)
        if len(kept) > 1:
            for number in self._deltas(spark, after=-1):
                if number <= kept[1]["upto"]:
                    Folder(spark, f"{self.path}/deltas").remove(f"batch_id={number}")
