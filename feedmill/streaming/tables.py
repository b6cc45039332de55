"""Streams over landed files and sinks into batch-stamped tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from feedmill.operators.dedup import first_by_key
from feedmill.schemas import required_present
from feedmill.session import staged
from feedmill.streaming.batches import read_batches, write_batch
from feedmill.streaming.keyindex import KeyIndex


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None, glob: str | None = None
) -> DataFrame:
    """Rows of Parquet files as they land below ``path``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def table_files(folder: str, table: str) -> str:
    """A path for :func:`file_stream` that takes the Parquet table ``table`` in ``folder`` whether it is one file or a folder of files.

    It is a pattern with one match: a stream refuses the path of a file, and a filter on file names would pass over
    the files in a table's own folder.
    """
    return f"{folder}/{table}.parque[t]"


def key_index(path: str, keys: Sequence[str]) -> KeyIndex:
    """The index of the keys of a table that :func:`insert_if_absent` fills."""
    return KeyIndex(f"{path}_keys", list(keys))


def insert_if_absent(path: str, key: str | Sequence[str], order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps one row per key over all batches [T7, D1, D6].

    With ``order`` the first row of a key in the batch wins; without it the rows of a key are equal.  What is stored is
    asked through a key index beside the table, so a batch reads filters and the few buckets that may hold its keys,
    not the history.  It compares with earlier batches only, so repeating a batch after a failure gives the same rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    index = key_index(path, keys)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index.merge(spark, before=batch_id)
        if order is None:
            rows = staged(batch.dropDuplicates(keys), "arrived")
            write_batch(index.absent(rows, before=batch_id), path, batch_id)
        else:
            rows = staged(batch, "arrived")
            winners = first_by_key(rows.filter(required_present(keys)).select(*keys, order), keys, order)
            fresh = index.absent(winners, before=batch_id).select(order)
            write_batch(rows.join(fresh, order, "left_semi"), path, batch_id)
        index.add(read_batches(spark, path, batch.schema).filter(F.col("batch_id") == batch_id), batch_id)

    return sink


def without_repeats_within(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """A stream without rows that repeat a key within ``delay`` of event time; the state it keeps is bounded by that [T7].

    It spares the sink the work on rows that land again and again; what returns later meets the key index.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that has landed, then stop."""
    query = (
        stream.writeStream.foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
