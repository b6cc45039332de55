"""Semantic search over article embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from feedmill.operators.joins import one_summary
from feedmill.operators.scoring import Encoder, embed
from feedmill.operators.search import check_arguments, check_limit, similarities


def search(
    query: Sequence[float],
    embeddings: DataFrame,
    articles: DataFrame,
    sources: DataFrame,
    summaries: DataFrame,
    limit: int = 10,
    per_article: bool = False,
    trusted_keys: bool = False,
) -> DataFrame:
    """The ``limit`` best rows with article, source and summary [V1, J4].

    Vectors are scored where they are scanned and only (id, similarity) goes on; it is cut to ``limit``
    (at most 50) rows before anything wide is read, and those few ids are pushed into the scans of the
    article and summary tables.  An article with several
    summaries takes several places, unless ``per_article`` picks one summary each.  Vectors without
    article or source never take a place; ``trusted_keys`` skips that semi join where the store
    already enforces the references.
    """
    check_limit(limit)
    scored = similarities(embeddings, query)
    if not trusted_keys:
        present = articles.select(F.col("id").alias("article_id"), "source_id").join(
            sources.select(F.col("id").alias("source_id")), "source_id", "left_semi"
        )
        scored = scored.join(present.select("article_id"), "article_id", "left_semi")
    best = scored.orderBy(F.desc("similarity"), "article_id").limit(limit).collect()
    ids = [row["article_id"] for row in best]
    hits = embeddings.sparkSession.createDataFrame(best, "article_id long, similarity double")
    found = articles.filter(F.col("id").isin(ids)).select(
        F.col("id").alias("article_id"), "source_id", "title", "url", "published_at"
    )
    texts = summaries.filter(F.col("article_id").isin(ids))
    chosen = one_summary(texts) if per_article else texts
    return (
        hits.join(found, "article_id")
        .join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
        .join(chosen.select("article_id", F.col("id").alias("summary_id"), "summary", "key_points"), "article_id", "left")
        .orderBy(F.desc("similarity"), "article_id", "summary_id")
        .limit(limit)
        .select(
            F.col("article_id").alias("id"), "title", "url", "published_at", "source_name", "summary", "key_points",
            "similarity",
        )
    )


def search_text(
    query: str,
    embeddings: DataFrame,
    articles: DataFrame,
    sources: DataFrame,
    summaries: DataFrame,
    limit: int = 10,
    encoder: Encoder | None = None,
    per_article: bool = False,
) -> DataFrame:
    """Text search: the query goes through the encoder that made the embeddings [M5, P19]."""
    check_arguments(query, limit)
    one = embeddings.sparkSession.createDataFrame([(0, query)], "id long, text string")
    vector = embed(one, "text", encoder).first()["embedding"]
    if vector is None:
        raise ValueError("the query could not be embedded")
    return search(vector, embeddings, articles, sources, summaries, limit, per_article)
