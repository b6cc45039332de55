"""Per-article processing state derived from an append-only event log, dead letters and plans.

Event columns: event_id, ts, article_id, status, stage, error, queue_name, model.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from feedmill import fixed_values as fv
from feedmill.functions.dates import moment
from feedmill.operators.filters import dead_letter_condition, scraped_since
from feedmill.session import staged

IS_ERROR = "error IS NOT NULL AND error <> ''"


def article_state(events: DataFrame) -> DataFrame:
    """Latest status, stage, retry count and error per article [T2, W7].

    Stage and error keep their last given value.  Everything is a map-side combined aggregate, so
    an article with a third of all events costs one partial row per task.
    """
    at = F.struct("ts", "event_id")
    failing = F.expr(IS_ERROR)
    return events.groupBy("article_id").agg(
        F.max_by("status", at).alias("status"),
        F.max_by("stage", F.when(F.col("stage").isNotNull(), at)).alias("current_stage"),
        F.count_if(failing).alias("retry_count"),
        F.max_by("error", F.when(failing, at)).alias("error_message"),
        F.max("ts").alias("updated_at"),
    )


def fold_state(state: DataFrame, events: DataFrame) -> DataFrame:
    """Current state plus a batch of events -> next state; unseen articles get a row [D4]."""
    new = article_state(events)
    old = state.select(*new.columns)
    late = F.col("n.updated_at") < F.col("o.updated_at")  # an older event adds its retries and replaces nothing
    both = old.alias("o").join(new.alias("n"), "article_id", "full_outer")
    return both.select(
        "article_id",
        F.when(late, F.coalesce("o.status", "n.status")).otherwise(F.coalesce("n.status", "o.status")).alias("status"),
        F.when(late, F.coalesce("o.current_stage", "n.current_stage")).otherwise(F.coalesce("n.current_stage", "o.current_stage")).alias("current_stage"),
        (F.coalesce("o.retry_count", F.lit(0)) + F.coalesce("n.retry_count", F.lit(0))).alias("retry_count"),
        F.when(late, F.coalesce("o.error_message", "n.error_message")).otherwise(F.coalesce("n.error_message", "o.error_message")).alias("error_message"),
        F.greatest("o.updated_at", "n.updated_at").alias("updated_at"),
    )


def running_count(rows: DataFrame, key: str, time: str, tie: str, name: str, before: DataFrame | None = None) -> DataFrame:
    """1-based position of every row within its key by (time, tie), skew-safe [W5].

    ``before`` (key, name) holds how many rows of a key were numbered already; its numbers go on from there.

    A plain window would sort all rows of a hot key in one task.  Here the rows are range-partitioned
    by (key, time, tie), which cuts a hot key into stretches of bounded size wherever its rows lie in
    time.  Rows are numbered inside their stretch and shifted by the sizes of the key's earlier
    stretches; only a key that runs over a partition's edge has a shift, so there are at most as many
    shifts as partitions.  The stretches are staged, because the range bounds are sampled and must
    be the same for the sizes and for the rows.
    """
    ranged = rows.repartitionByRange(key, time, tie).withColumn("_stretch", F.spark_partition_id())
    kept = staged(ranged, "stretches")
    sizes = kept.groupBy(key, "_stretch").agg(F.count("*").alias("_size"))
    earlier = W.partitionBy(key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(key, "_stretch", F.sum("_size").over(earlier).alias("_shift")).filter("_shift IS NOT NULL")
    inside = F.row_number().over(W.partitionBy(key, "_stretch").orderBy(time, tie))
    if before is not None:  # meets a row per key and stretch, never the rows themselves
        given = before.select(F.col(key).alias("_of"), F.col(name).alias("_before")).filter("_before > 0")
        every = sizes.select(key, "_stretch", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
        met = every.join(given, F.col(key).eqNullSafe(F.col("_of")), "left")
        shifts = met.select(key, "_stretch", (F.col("_shift") + F.coalesce("_before", F.lit(0))).alias("_shift"))
    shifts = shifts.select(F.col(key).alias("_of"), F.col("_stretch").alias("_at"), "_shift")
    return (
        kept.withColumn(name, inside)
        .join(shifts, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_stretch") == F.col("_at")), "left")
        .withColumn(name, F.col(name) + F.coalesce("_shift", F.lit(0)))
        .drop("_stretch", "_shift", "_of", "_at")
    )


def dead_letters(events: DataFrame, max_retries: int = fv.MAX_RETRIES, first_only: bool = False) -> DataFrame:
    """A dead letter for every failure at or past the retry limit, or only the first of them [T3]."""
    failures = events.filter(IS_ERROR)
    counted = running_count(failures, "article_id", "ts", "event_id", "retry_count")
    limit = F.col("retry_count") == max_retries if first_only else F.col("retry_count") >= max_retries
    return counted.filter(limit).select(*dead_letter_columns())


def dead_letter_columns() -> list[Column]:
    """An event that went past the limit, in the shape of the dead letter table."""
    return [
        F.col("event_id").alias("id"),
        F.col("article_id"),
        F.coalesce("queue_name", "stage", F.lit(fv.UNKNOWN_QUEUE)).alias("queue_name"),
        F.struct(F.col("article_id"), F.col("model")).alias("payload"),
        F.col("error").alias("error_message"),
        F.col("retry_count").cast("long").alias("retry_count"),
        F.col("ts").alias("failed_at"),
        F.lit(None).cast("timestamp_ntz").alias("replayed_at"),
        F.lit(False).alias("replayed"),
    ]


def search_dead_letters(letters: DataFrame, **arguments) -> DataFrame:
    """Dead letters by optional queue, since, replayed and ids, newest first [P8, K4, M8]."""
    return letters.filter(dead_letter_condition(**arguments)).orderBy(F.desc("failed_at"), "id")


def replay_plan(letters: DataFrame) -> DataFrame:
    """Where each dead letter goes, or why it is skipped [T4]."""
    gone = F.col("article_id").isNull()
    known = F.col("queue_name").isin(list(fv.STAGES))
    routed = ~gone & known
    return letters.select(
        "id",
        "article_id",
        F.when(routed, F.col("queue_name")).alias("target_queue"),
        F.when(routed & (F.col("queue_name") == "summarization"), F.col("payload.model")).alias("model"),
        F.when(gone, F.lit("article deleted")).when(~known, F.lit("unknown queue")).alias("skip_reason"),
    )


def summarised_by(articles: DataFrame, summaries: DataFrame, model: str) -> DataFrame:
    """Articles with a summary by ``model``, each once [J8]."""
    keys = summaries.filter(F.col("model") == model).select(F.col("article_id").alias("id"))
    return articles.join(keys, "id", "left_semi")


def backfill_stage(model: str | None, since: datetime | str | None, stage: str | None) -> str:
    """The stage to restart from: explicit, else by the kind of selection [T5]."""
    if model is None and since is None:
        raise ValueError("give a model, a date or both")
    if stage is not None and stage not in fv.STAGES:
        raise ValueError(f"stage must be one of {fv.STAGES}")
    return stage or ("summarization" if since is None else "extraction")


def backfill_plan(
    articles: DataFrame,
    summaries: DataFrame,
    model: str | None = None,
    since: datetime | str | None = None,
    stage: str | None = None,
) -> DataFrame:
    """(article_id, stage, selected_by) of the articles to process again, each once [T5, U2]."""
    target = backfill_stage(model, since, stage)
    parts = []
    if model is not None:
        parts.append(summarised_by(articles, summaries, model).select("id", F.lit(0).alias("_rank")))
    if since is not None:
        parts.append(scraped_since(articles, moment(since)).select("id", F.lit(1).alias("_rank")))
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    by = F.when(F.min("_rank") == 0, F.lit("model")).otherwise(F.lit("since"))
    return chosen.groupBy(F.col("id").alias("article_id")).agg(by.alias("selected_by")).withColumn("stage", F.lit(target))


def enqueue_plan(articles: DataFrame, key: str = "id") -> DataFrame:
    """Work list of the first stage; a row without a key cannot be queued [T6]."""
    return articles.select(
        F.col(key).alias("article_id"),
        F.lit("extraction").alias("queue_name"),
        F.col(key).isNotNull().alias("enqueued"),
    )


def enqueue_counts(plan: DataFrame) -> DataFrame:
    """{found, enqueued, failed} [T6]."""
    return plan.agg(
        F.count("*").alias("found"),
        F.count_if(F.col("enqueued")).alias("enqueued"),
        F.count_if(~F.col("enqueued")).alias("failed"),
    )


def clear_failed(state: DataFrame, queue: str | None = None) -> DataFrame:
    """State without its failed entries, of one stage or of all [T9]."""
    failed = F.col("status") == "failed"
    if queue is not None:
        if queue not in fv.QUEUES:
            return state
        failed = failed & F.col("current_stage").eqNullSafe(queue)
    return state.filter(~F.coalesce(failed, F.lit(False)))
