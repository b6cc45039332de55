"""Row filters.  Every window ends at an explicit ``as_of``; nothing reads the clock."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from feedmill import fixed_values as fv
from feedmill.functions.dates import cutoff, literal_time


def scraped_within(df: DataFrame, as_of: datetime | str, hours: float) -> DataFrame:
    """Rows scraped in the last ``hours`` hours, the boundary included [P1]."""
    return df.filter(F.col("scraped_at") >= cutoff(as_of, hours))


def scraped_since(df: DataFrame, since: datetime | str) -> DataFrame:
    """Rows scraped on or after a date [P1]."""
    return df.filter(F.col("scraped_at") >= literal_time(since))


def published_within(df: DataFrame, as_of: datetime | str, hours: float, keep_undated: bool = False) -> DataFrame:
    """Rows published in the window; undated rows are dropped [P2] or kept [P3]."""
    recent = F.col("published_at") >= cutoff(as_of, hours)
    return df.filter(F.col("published_at").isNull() | recent if keep_undated else recent)


def lookup(df: DataFrame, column: str, wanted: object | Sequence[object] | DataFrame) -> DataFrame:
    """Point lookup by one value or a few, or by a key table through a semi join [P4]."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(column), column, "left_semi")
    if isinstance(wanted, (list, tuple)):
        return df.filter(F.col(column).isin(list(wanted)))
    return df.filter(F.col(column) == F.lit(wanted))


def active_rows(df: DataFrame, flag: str = "active", active_only: bool = True) -> DataFrame:
    """Active rows, or all of them when ``active_only`` is off [P5]."""
    return df.filter(F.col(flag)) if active_only else df


def sources_of_type(sources: DataFrame, source_type: str, active_only: bool = True) -> DataFrame:
    """Sources of one type [P5]."""
    if source_type not in fv.SOURCE_TYPES:
        raise ValueError(f"source_type must be one of {fv.SOURCE_TYPES}")
    return active_rows(sources.filter(F.col("source_type") == source_type), "active", active_only)


def needing_work(
    articles: DataFrame, as_of: datetime | str, hours: float, statuses: Sequence[str] = ("pending", "failed")
) -> DataFrame:
    """Recent articles whose processing has not succeeded [P6]."""
    return scraped_within(articles, as_of, hours).filter(F.col("processing_status").isin(list(statuses)))


def retryable(state: DataFrame, max_retries: int = fv.MAX_RETRIES) -> DataFrame:
    """Failed articles with retries left [P7]."""
    return state.filter((F.col("status") == "failed") & (F.col("retry_count") < max_retries))


def dead_letter_condition(
    queue: str | None = None,
    since: datetime | str | None = None,
    include_replayed: bool = False,
    ids: Sequence[int] | None = None,
) -> Column:
    """Optional search arguments folded into one predicate [P8]."""
    if ids is not None:
        return F.col("id").isin(list(ids))
    condition = F.lit(True)
    if queue is not None:
        condition = condition & (F.col("queue_name") == queue)
    if since is not None:
        condition = condition & (F.col("failed_at") >= literal_time(since))
    return condition if include_replayed else condition & ~F.col("replayed")
