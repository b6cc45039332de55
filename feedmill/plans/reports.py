"""Operational reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from feedmill.operators.aggregates import count_by, queue_depth
from feedmill.operators.filters import active_rows, scraped_within
from feedmill.operators.joins import lineage
from feedmill.session import staged


def lineage_report(
    articles: DataFrame, state: DataFrame, summaries: DataFrame, embeddings: DataFrame,
    as_of: datetime | str, hours: float = 24,
) -> DataFrame:
    """Lineage of the articles scraped in the window [M6].

    The window's ids are staged, so a window that is small beside the feature tables is broadcast.
    """
    window = staged(scraped_within(articles.select("id", "title", "scraped_at"), as_of, hours), "window")
    return lineage(window, state, summaries, embeddings)


def pipeline_status(state: DataFrame) -> DataFrame:
    """(section, label, pending, failed, n): counts by status and depth by stage [M9]."""
    none = F.lit(None).cast("long")
    by_status = count_by(state, "status").select(
        F.lit("status").alias("section"), F.col("status").alias("label"), none.alias("pending"),
        none.alias("failed"), "n",
    )
    by_stage = queue_depth(state).select(
        F.lit("queue").alias("section"), F.col("current_stage").alias("label"), "pending", "failed", none.alias("n")
    )
    return by_status.unionByName(by_stage)


def source_list(sources: DataFrame, active_only: bool = False) -> DataFrame:
    """Sources with a readable status [M10]."""
    return active_rows(sources, "active", active_only).select(
        "id", "name", "source_type", "url",
        F.when(F.col("active"), F.lit("Active")).otherwise(F.lit("Inactive")).alias("status"),
    )
