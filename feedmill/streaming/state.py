"""Processing state and dead letters kept up to date by streams of events [T2, T3]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from feedmill import fixed_values as fv, schemas
from feedmill.operators.state import IS_ERROR, article_state, dead_letter_columns, running_count
from feedmill.session import staged
from feedmill.streaming.snapshots import KeyedTable
from feedmill.streaming.tables import read_batches, run_available, write_batch

STATE = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("current_stage", T.StringType()),
        T.StructField("retry_count", T.LongType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)
TOTALS = T.StructType([T.StructField("article_id", T.LongType()), T.StructField("retry_count", T.LongType())])
#: Deltas that may stand beside a snapshot before they are folded into it.
COMPACT_EVERY = 16


def state_table(path: str) -> KeyedTable:
    return KeyedTable(path, STATE, "article_id")


def totals_table(path: str) -> KeyedTable:
    """Failures counted so far per article, beside the dead letters at ``path``."""
    return KeyedTable(f"{path}_totals", TOTALS, "article_id", sums=True)


def _compacting(table: KeyedTable, spark: SparkSession, batch: int, every: int) -> None:
    """Before a batch is written, fold the deltas of earlier ones, which are never repeated."""
    if table.pending(spark) >= every:
        table.compact(spark, before=batch)


def update_state(events: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> None:
    """Fold new events into the state; every batch writes the articles that changed.

    This is a built-in streaming aggregate: events are combined on the map side before they reach
    the state store, so an article with very many events costs one partial row per task.  The table is compacted
    whenever ``compact_every`` deltas have gathered.
    """
    table = state_table(path)

    def sink(rows: DataFrame, batch: int) -> None:
        _compacting(table, rows.sparkSession, batch, compact_every)
        table.write(rows, batch)

    run_available(article_state(events), sink, checkpoint, "update")


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """The latest written row per article."""
    return state_table(path).read(spark)


def update_dead_letters(
    events: DataFrame, path: str, checkpoint: str, max_retries: int = fv.MAX_RETRIES, compact_every: int = COMPACT_EVERY
) -> None:
    """Append the dead letters new events give rise to, counting on two levels.

    The failures of a micro-batch are numbered per article by :func:`running_count`, in stretches that cut a hot article
    into many tasks; the numbers go on from the article's total of earlier batches, which is a slim keyed table.
    """
    totals = totals_table(path)

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _compacting(totals, spark, number, compact_every)
        failures = staged(batch, "failures")
        counted = running_count(failures, "article_id", "ts", "event_id", "retry_count", totals.read(spark, before=number))
        write_batch(counted.filter(F.col("retry_count") >= max_retries).select(*dead_letter_columns()), path, number)
        totals.write(failures.groupBy("article_id").agg(F.count("*").alias("retry_count")), number)

    columns = ["article_id", "event_id", "ts", "stage", "error", "queue_name", "model"]
    run_available(events.filter(IS_ERROR).select(*columns), sink, checkpoint)


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """All dead letters written so far."""
    return read_batches(spark, path, schemas.DEAD_LETTERS).drop("batch_id")
