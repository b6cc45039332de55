"""Insert-if-absent and content duplicates.

A URL or a text may be copied into a third of all rows, so no step groups whole rows by it: the
first copy is a partial aggregate over two slim columns, and rows find their verdict through their
own unique key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from feedmill.schemas import required_present

REQUIRED = ("source_id", "title", "url")


def absent_keys(candidates: DataFrame, store: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Candidate rows whose key the store does not hold [J9]."""
    keys = [key] if isinstance(key, str) else list(key)
    return candidates.join(store.select(*keys), keys, "left_anti")


def first_by_key(rows: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """(key, order) of the first row per key [W4]; a map-side combined minimum, not a window."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def label_candidates(
    candidates: DataFrame,
    store: DataFrame,
    key: str = "url",
    order: str = "ingest_seq",
    required: Sequence[str] = REQUIRED,
) -> DataFrame:
    """Candidates with ``outcome``: created, duplicate or error [D1].

    The first row per key in ``order`` wins inside the batch, and any key the store holds is a
    duplicate.  ``order`` must be unique in the batch.  Rows that miss a required column are errors.
    """
    valid = required_present(required)
    winners = first_by_key(candidates.filter(valid).select(key, order), key, order)
    fresh = absent_keys(winners, store, key).select(order, F.lit(True).alias("_fresh"))
    return (
        candidates.join(fresh, order, "left")
        .withColumn(
            "outcome",
            F.when(~valid, F.lit("error")).when(F.col("_fresh"), F.lit("created")).otherwise(F.lit("duplicate")),
        )
        .drop("_fresh")
    )


def insert_new(
    candidates: DataFrame,
    store: DataFrame,
    key: str = "url",
    order: str = "ingest_seq",
    required: Sequence[str] = REQUIRED,
) -> DataFrame:
    """The rows :func:`label_candidates` marks as created [D1]."""
    slim = candidates.filter(required_present(required)).select(key, order)
    fresh = absent_keys(first_by_key(slim, key, order), store, key).select(order)
    return candidates.join(fresh, order, "left_semi")


def outcome_counts(labelled: DataFrame) -> DataFrame:
    """{created, duplicates, errors} of a labelled batch [D1]."""
    return labelled.agg(
        F.count_if(F.col("outcome") == "created").alias("created"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )


def copy_groups(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(content_hash, first key, copies) per distinct text [D3, documented only]."""
    hashed = documents.select(F.sha2(F.col(text), 256).alias("content_hash"), key)
    return hashed.groupBy("content_hash").agg(F.min(key).alias(f"first_{key}"), F.count("*").alias("copies"))


def first_copies(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Keys of the first document of every distinct text [D3]."""
    return copy_groups(documents, text, key).select(F.col(f"first_{key}").alias(key))


def label_copies(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, is_duplicate) for every document [D3]."""
    first = first_copies(documents, text, key).withColumn("_first", F.lit(True))
    return documents.select(key).join(first, key, "left").select(key, F.col("_first").isNull().alias("is_duplicate"))
