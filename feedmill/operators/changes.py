"""Keyed changes over plain tables: upserts are an anti join plus a union, updates a left join."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from feedmill.functions.dates import literal_time
from feedmill.functions.urls import valid_email


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` replace rows with the same key and are added where the key is absent [D5]."""
    kept = table.join(rows.select(key), key, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def reset_for_stage(state: DataFrame, article_ids: DataFrame, stage: str) -> DataFrame:
    """Backfill reset: pending at ``stage``, no retries, no error, not completed; added when absent [D5]."""
    reset = article_ids.select(
        "article_id",
        F.lit("pending").alias("status"),
        F.lit(stage).alias("current_stage"),
        F.lit(0).cast("long").alias("retry_count"),
    ).distinct()
    return upsert(state, reset, "article_id")


def apply_changes(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Set ``column`` for the keys in ``changes`` (one row per key); other rows keep theirs [D7]."""
    new = changes.select(key, F.col(column).alias("_new"))
    return (
        table.join(new, key, "left")
        .withColumn(column, F.coalesce("_new", column))
        .select(*table.columns)
    )


def toggle(table: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """Flip ``flag`` for the given keys [D7]."""
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return (
        table.join(hit, key, "left")
        .withColumn(flag, F.when(F.col("_hit"), ~F.col(flag)).otherwise(F.col(flag)))
        .select(*table.columns)
    )


def remap(table: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by ``mapping.new`` where it equals ``mapping.old`` [D8]."""
    return (
        table.join(mapping.select(F.col("old").alias(column), "new"), column, "left")
        .withColumn(column, F.coalesce("new", column))
        .select(*table.columns)
    )


def remap_report(table: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """(old, new, rows_updated); zero where nothing held the old value [D8].

    The table is counted per value before the join, so a value held by very many rows is one row.
    """
    held = table.groupBy(F.col(column).alias("old")).agg(F.count("*").alias("_held"))
    return mapping.join(held, "old", "left").select("old", "new", F.coalesce("_held", F.lit(0)).alias("rows_updated"))


def new_subscriptions(requests: DataFrame, existing: DataFrame, order: str = "request_seq") -> DataFrame:
    """Requests with ``outcome``: created, exists (an earlier one wins) or invalid [D9]."""
    valid = requests.filter(valid_email(F.col("email")))
    winners = valid.groupBy("email").agg(F.min(order).alias(order))
    fresh = winners.join(existing.select("email"), "email", "left_anti").select(order, F.lit(True).alias("_fresh"))
    return (
        requests.join(fresh, order, "left")
        .withColumn(
            "outcome",
            F.when(~valid_email(F.col("email")), F.lit("invalid"))
            .when(F.col("_fresh"), F.lit("created"))
            .otherwise(F.lit("exists")),
        )
        .drop("_fresh")
    )


def apply_subscription_log(subscriptions: DataFrame, log: DataFrame) -> DataFrame:
    """Fold an ordered log (id, seq, action, frequency) into the subscriptions [D9].

    ``action`` is ``frequency``, ``unsubscribe`` or ``reactivate``; the latest of each kind wins.
    The fold is a partial aggregate, so one very busy subscriber does not end up in one task.
    """
    switches = F.col("action").isin("unsubscribe", "reactivate")
    latest = log.groupBy("id").agg(
        F.max_by(F.when(switches, F.col("action") == "reactivate"), F.when(switches, F.col("seq"))).alias("_active"),
        F.max_by("frequency", F.when(F.col("action") == "frequency", F.col("seq"))).alias("_frequency"),
    )
    return (
        subscriptions.join(latest, "id", "left")
        .withColumn("is_active", F.coalesce("_active", "is_active"))
        .withColumn("frequency", F.coalesce("_frequency", "frequency"))
        .select(*subscriptions.columns)
    )


def mark_replayed(dead_letters: DataFrame, plan: DataFrame, as_of: datetime | str) -> DataFrame:
    """Flag the dead letters the plan routed [D10]."""
    routed = plan.filter(F.col("skip_reason").isNull()).select("id", F.lit(True).alias("_routed"))
    now = literal_time(as_of)
    return (
        dead_letters.join(routed, "id", "left")
        .withColumn("replayed_at", F.when(F.col("_routed"), now).otherwise(F.col("replayed_at")))
        .withColumn("replayed", F.col("replayed") | F.coalesce("_routed", F.lit(False)))
        .select(*dead_letters.columns)
    )


def cascade(children: DataFrame, parents: DataFrame, key: str = "article_id", parent_key: str = "id") -> DataFrame:
    """Children whose parent survives [J13, cascade]."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def set_null(children: DataFrame, parents: DataFrame, key: str = "article_id", parent_key: str = "id") -> DataFrame:
    """All children; the reference is emptied where the parent is gone [J13, set null]."""
    alive = parents.select(F.col(parent_key).alias(key), F.lit(True).alias("_alive"))
    return (
        children.join(alive, key, "left")
        .withColumn(key, F.when(F.col("_alive"), F.col(key)))
        .select(*children.columns)
    )


def orphans(children: DataFrame, parents: DataFrame, key: str = "article_id", parent_key: str = "id") -> DataFrame:
    """Children whose parent is missing [J13, audit]."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
