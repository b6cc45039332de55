"""One explicit schema per table, and contract checks on allowed values and required columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedmill import fixed_values as fv


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


_LONG, _TEXT, _FLAG, _TIME = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()
_INT, _REAL = T.IntegerType(), T.DoubleType()

SOURCES = _table(
    ("id", _LONG, False), ("name", _TEXT, False), ("source_type", _TEXT, False),
    ("url", _TEXT, False), ("active", _FLAG, False), ("created_at", _TIME, True),
)
ARTICLES = _table(
    ("id", _LONG, False), ("source_id", _LONG, False), ("title", _TEXT, False), ("url", _TEXT, False),
    ("content", _TEXT, True), ("published_at", _TIME, True), ("scraped_at", _TIME, False),
    ("video_id", _TEXT, True), ("category", _TEXT, True), ("processing_status", _TEXT, True),
    ("full_content", _TEXT, True), ("extraction_method", _TEXT, True),
)
ARTICLE_SUMMARIES = _table(
    ("id", _LONG, False), ("article_id", _LONG, False), ("model", _TEXT, False), ("summary", _TEXT, False),
    ("key_points", T.ArrayType(_TEXT), True), ("created_at", _TIME, True),
)
ARTICLE_EMBEDDINGS = _table(
    ("id", _LONG, False), ("article_id", _LONG, False), ("embedding", T.ArrayType(T.FloatType()), False),
    ("model", _TEXT, False), ("created_at", _TIME, True),
)
EMAIL_SUBSCRIPTIONS = _table(
    ("id", _LONG, False), ("email", _TEXT, False), ("name", _TEXT, True), ("frequency", _TEXT, False),
    ("source_filters", T.ArrayType(_LONG), True), ("is_active", _FLAG, False),
    ("created_at", _TIME, True), ("updated_at", _TIME, True), ("last_sent_at", _TIME, True),
)
EMAIL_DELIVERIES = _table(
    ("id", _LONG, True), ("subscription_id", _LONG, False), ("status", _TEXT, False),
    ("articles_count", _LONG, True), ("articles_ids", T.ArrayType(_LONG), True), ("sent_at", _TIME, True),
    ("error_message", _TEXT, True), ("created_at", _TIME, True),
)
PROCESSING_QUEUE = _table(
    ("article_id", _LONG, False), ("status", _TEXT, False), ("current_stage", _TEXT, True),
    ("retry_count", _LONG, False), ("error_message", _TEXT, True), ("updated_at", _TIME, True),
    ("completed_at", _TIME, True),
)
PIPELINE_RUNS = _table(
    ("id", _LONG, True), ("started_at", _TIME, False), ("completed_at", _TIME, True),
    ("articles_processed", _LONG, False), ("articles_failed", _LONG, False),
    ("articles_skipped", _LONG, False), ("trigger", _TEXT, False),
)
DEAD_LETTERS = _table(
    ("id", _LONG, False), ("article_id", _LONG, True), ("queue_name", _TEXT, False),
    ("payload", T.StructType([T.StructField("article_id", _LONG), T.StructField("model", _TEXT)]), True),
    ("error_message", _TEXT, True), ("retry_count", _LONG, False), ("failed_at", _TIME, False),
    ("replayed_at", _TIME, True), ("replayed", _FLAG, False),
)
PROCESSING_EVENTS = _table(
    ("event_id", _LONG, False), ("ts", _TIME, False), ("article_id", _LONG, False), ("status", _TEXT, False),
    ("stage", _TEXT, True), ("error", _TEXT, True), ("queue_name", _TEXT, True), ("model", _TEXT, True),
)
FEED_ENTRIES = _table(
    ("feed_url", _TEXT, False), ("category", _TEXT, True), ("title", _TEXT, False), ("url", _TEXT, False),
    ("published_at", _TIME, True), ("summary", _TEXT, False), ("video_id", _TEXT, True),
)
TRANSCRIPT_SEGMENTS = _table(
    ("video_id", _TEXT, False), ("language", _TEXT, False), ("seq", _LONG, False), ("text", _TEXT, False),
)
LANDED_FEEDS = _table(("feed_url", _TEXT, False), ("xml", _TEXT, True))
LANDED_PAGES = _table(("url", _TEXT, False), ("html", _TEXT, True))

TABLES: dict[str, T.StructType] = {
    "sources": SOURCES,
    "articles": ARTICLES,
    "article_summaries": ARTICLE_SUMMARIES,
    "article_embeddings": ARTICLE_EMBEDDINGS,
    "email_subscriptions": EMAIL_SUBSCRIPTIONS,
    "email_deliveries": EMAIL_DELIVERIES,
    "processing_queue": PROCESSING_QUEUE,
    "pipeline_runs": PIPELINE_RUNS,
    "dead_letters": DEAD_LETTERS,
}

ALLOWED_VALUES: dict[tuple[str, str], tuple[str, ...]] = {
    ("sources", "source_type"): fv.SOURCE_TYPES,
    ("articles", "processing_status"): fv.PROCESSING_STATUSES,
    ("processing_queue", "status"): fv.PROCESSING_STATUSES,
    ("email_subscriptions", "frequency"): fv.EMAIL_FREQUENCIES,
    ("email_deliveries", "status"): fv.DELIVERY_STATUSES,
}


def required_present(required: Sequence[str]) -> Column:
    """True when every column of ``required`` is non-NULL."""
    ok = F.lit(True)
    for name in required:
        ok = ok & F.col(name).isNotNull()
    return ok


def normalise_enum(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Fold label drift (case, blanks) to lower case and flag labels outside ``allowed`` [D11].

    Adds ``<column>_ok``; callers split the frame on it into accepted rows and rejects.
    """
    folded = F.lower(F.trim(F.col(column)))
    return df.withColumn(column, folded).withColumn(
        f"{column}_ok", F.coalesce(F.col(column).isin(list(allowed)), F.lit(False))
    )


def as_table(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto a table's schema; columns it lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].fields
        ]
    )
