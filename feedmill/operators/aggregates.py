"""Counts and rollups; all of them combine on the map side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def count_by(rows: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value [A1, A3]."""
    return rows.groupBy(column).agg(F.count("*").alias(name))


def count_allowed(rows: DataFrame, column: str, allowed: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per allowed value, absent values with zero [A15]."""
    spark = rows.sparkSession
    labels = spark.createDataFrame([(v,) for v in allowed], f"{column} string")
    return labels.join(count_by(rows, column, "_n"), column, "left").select(
        column, F.coalesce("_n", F.lit(0)).alias(name)
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) per table [A6]."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def queue_depth(state: DataFrame) -> DataFrame:
    """Pending and failed entries per stage [A7]."""
    return state.groupBy("current_stage").agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def queue_totals(depth: DataFrame) -> DataFrame:
    """Totals over all stages [A7]."""
    return depth.agg(
        F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed")
    )


def ingest_stats(labelled: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources processed, articles found, new, duplicate and errors of one ingest [A4].

    ``sources`` are the sources that were scanned: a source whose feed was empty still counts.
    """
    scanned = sources.agg(F.count("*").alias("n")).scalar()
    return labelled.agg(
        F.count("*").alias("articles_found"),
        F.count_if(F.col("outcome") == "created").alias("articles_new"),
        F.count_if(F.col("outcome") == "duplicate").alias("articles_duplicate"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    ).withColumn("sources_processed", scanned)


def origin_totals(labelled: DataFrame, origin: str = "origin") -> DataFrame:
    """Items, created, duplicates and errors per origin plus a total row (``all``) [A5]."""
    counts = labelled.rollup(origin).agg(
        F.count("*").alias("items"),
        F.count_if(F.col("outcome") == "created").alias("created"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.grouping(origin).alias("_total"),
    )
    return counts.select(
        F.when(F.col("_total") == 1, F.lit("all")).otherwise(F.col(origin)).alias(origin),
        "items", "created", "duplicates", "errors",
    )


def delivery_summary(deliveries: DataFrame, by: str | None = None) -> DataFrame:
    """Total, sent and failed deliveries, overall or per ``by`` [A8]."""
    counts = [
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "sent").alias("sent"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    ]
    return deliveries.agg(*counts) if by is None else deliveries.groupBy(by).agg(*counts)


def health_rollup(checks: DataFrame) -> DataFrame:
    """healthy when all checks pass, degraded when some do, else unhealthy [A9]."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return checks.agg(
        F.when(F.coalesce(F.bool_and(ok), F.lit(False)), F.lit("healthy"))
        .when(F.coalesce(F.bool_or(ok), F.lit(False)), F.lit("degraded"))
        .otherwise(F.lit("unhealthy"))
        .alias("status"),
        F.count("*").alias("checks"),
        F.count_if(ok).alias("passed"),
    )


def presence_split(rows: DataFrame, column: Column) -> DataFrame:
    """Rows with and without a value [A10]."""
    return rows.agg(
        F.count_if(column.isNotNull()).alias("with_value"), F.count_if(column.isNull()).alias("without_value")
    )


def completeness(articles: DataFrame, summaries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Share of articles with a summary and with an embedding, in percent [A16, documented only]."""
    has_s = summaries.select(F.col("article_id").alias("id"), F.lit(True).alias("_s")).distinct()
    has_e = embeddings.select(F.col("article_id").alias("id"), F.lit(True).alias("_e")).distinct()
    joined = articles.select("id").join(has_s, "id", "left").join(has_e, "id", "left")
    share = lambda c: F.round(F.try_divide(F.count_if(c.isNotNull()) * F.lit(100.0), F.count("*")), 6)
    return joined.agg(
        F.count("*").alias("articles"),
        share(F.col("_s")).alias("pct_with_summary"),
        share(F.col("_e")).alias("pct_with_embedding"),
    )


def run_audit(
    stage_results: DataFrame, started_at: Column, completed_at: Column, trigger: str = "scheduled"
) -> DataFrame:
    """One audit row for a run from its outcome rows [A11]."""
    counted = stage_results.agg(
        F.count_if(F.col("outcome") == "success").alias("articles_processed"),
        F.count_if(F.col("outcome") == "failed").alias("articles_failed"),
        F.count_if(F.col("outcome") == "skipped").alias("articles_skipped"),
    )
    return counted.select(
        started_at.alias("started_at"), completed_at.alias("completed_at"), "*", F.lit(trigger).alias("trigger")
    )


def run_trend(runs: DataFrame) -> DataFrame:
    """Runs and article counts per day of the audit table [A17]."""
    return runs.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("runs"),
        F.sum("articles_processed").alias("processed"),
        F.sum("articles_failed").alias("failed"),
        F.sum("articles_skipped").alias("skipped"),
    )
