"""Top-n per group, numbering and ordered limits.  Every order ends in a unique column."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from feedmill import fixed_values as fv
from feedmill.operators.filters import published_within, scraped_within
from feedmill.session import staged


def newest_first() -> list[Column]:
    """Newest published first; undated rows lead, as the reference database orders them [K2, K3]."""
    return [F.col("published_at").desc_nulls_first(), F.col("id").asc()]


def top_keys(
    rows: DataFrame, group: str, n: int, order: Sequence[Column], position: str = "position", key: str = "id"
) -> DataFrame:
    """(key, position) of the first ``n`` rows of every group.

    Only group, key and order columns are ranked: the per-task group limit keeps at most ``n`` rows
    of a group before the shuffle, so a dominant group is cut where it is read.
    """
    needed = [c for c in (group, key, "published_at") if c in rows.columns]
    ranked = rows.select(*dict.fromkeys(needed)).withColumn(
        position, F.row_number().over(W.partitionBy(group).orderBy(*order))
    )
    return ranked.filter(F.col(position) <= n).select(key, position)


def top_per_group(
    rows: DataFrame, group: str, n: int, order: Sequence[Column], position: str = "position", key: str = "id"
) -> DataFrame:
    """The first ``n`` rows of every group with their 1-based position [W1, W2, W3].

    The wide columns come back by ``key`` for the rows that remain.  Those keys are staged first: the
    planner then knows how few they are and broadcasts them, instead of shuffling the wide rows to
    meet them.
    """
    return rows.join(staged(top_keys(rows, group, n, order, position, key), "top"), key)


def running_total(rows: DataFrame, order: Sequence[Column], size: str, name: str) -> DataFrame:
    """Rows with ``name``: the sum of ``size`` over all rows before them in one global order.

    Rows are range-partitioned by the order and summed inside their stretch; the only unpartitioned window runs over
    one total per stretch.  The stretches are staged, because the sampled bounds must be the same for the totals
    and for the rows.  ``order`` must end in a unique column.
    """
    kept = staged(rows.repartitionByRange(*order).withColumn("_stretch", F.spark_partition_id()), "stretches")
    before = (W.unboundedPreceding, -1)
    totals = kept.groupBy("_stretch").agg(F.sum(size).alias("_total"))
    shifts = totals.select("_stretch", F.sum("_total").over(W.orderBy("_stretch").rowsBetween(*before)).alias("_shift"))
    inside = F.sum(size).over(W.partitionBy("_stretch").orderBy(*order).rowsBetween(*before))
    summed = kept.withColumn("_inside", inside).join(shifts, "_stretch")
    start = F.coalesce("_inside", F.lit(0)) + F.coalesce("_shift", F.lit(0))
    return summed.withColumn(name, start.cast("bigint")).drop("_stretch", "_inside", "_shift")


def recent_articles(
    articles: DataFrame, as_of: datetime | str, hours: float = fv.DEFAULT_HOURS_BACK, limit: int = fv.RECENT_LIMIT
) -> DataFrame:
    """Most recently scraped articles [K1]."""
    return scraped_within(articles, as_of, hours).orderBy(F.desc("scraped_at"), "id").limit(limit)


def articles_of_source(articles: DataFrame, source_id: int, limit: int = fv.RECENT_LIMIT) -> DataFrame:
    """Newest articles of one source [K2]."""
    return articles.filter(F.col("source_id") == source_id).orderBy(*newest_first()).limit(limit)


def any_recent(articles: DataFrame, as_of: datetime | str, hours: float, limit: int) -> DataFrame:
    """``limit`` recently published articles; the lowest ids, so the pick is repeatable [K6]."""
    return published_within(articles, as_of, hours).orderBy("id").limit(limit)


def first_with_summaries(articles: DataFrame, summaries: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows (id, title, model, summary) of the joined tables by id and model [J12].

    The (id, model) keys alone are ranked; the ids of those at most ``limit`` rows are then pushed into the scans of
    titles and texts.
    """
    keys = articles.select("id").join(summaries.select(F.col("article_id").alias("id"), "model"), "id")
    ids = [row["id"] for row in keys.orderBy("id", "model").limit(limit).select("id").distinct().collect()]
    titles = articles.filter(F.col("id").isin(ids)).select("id", "title")
    texts = summaries.filter(F.col("article_id").isin(ids)).select(F.col("article_id").alias("id"), "model", "summary")
    return titles.join(texts, "id").orderBy("id", "model").limit(limit).select("id", "title", "model", "summary")


def latest_runs(runs: DataFrame, limit: int = fv.RUN_HISTORY_LIMIT) -> DataFrame:
    """The last runs [K5]."""
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)
