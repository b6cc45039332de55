"""Joins of the feature tables.

No join carries a broadcast hint: Spark broadcasts a side only while its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both, where adaptive execution
splits skewed partitions.  Wide text columns are selected after the filters that need none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from feedmill.functions.text import present


def with_source(articles: DataFrame, sources: DataFrame, source_name: str | None = None) -> DataFrame:
    """Articles with their source's name; optionally of one source name only [J3, J2]."""
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    if source_name is not None:
        named = named.filter(F.col("source_name") == source_name)
    return articles.join(named, "source_id")


def with_summaries(articles: DataFrame, summaries: DataFrame, how: str = "inner") -> DataFrame:
    """One row per (article, summary): several summaries fan out [J1]."""
    slim = summaries.select(F.col("article_id").alias("id"), "summary", "key_points", "model")
    return articles.join(slim, "id", how)


def one_summary(summaries: DataFrame) -> DataFrame:
    """The summary with the lowest id per article [W6].

    Summaries without an id come after all others, the first by time and model.

    The lowest id is a hash aggregate over (article, id) alone, and the texts are streamed past a hash table of those keys, so
    no wide row is sorted.  Only articles whose lowest id is missing or given to several rows have their rows ranked, by
    a window whose group limit works before the shuffle.
    """
    rest = [c for c in summaries.columns if c != "article_id"]
    counted = summaries.groupBy("article_id", "id").agg(F.count("*").alias("_n"))
    lowest = counted.groupBy("article_id").agg(
        F.min("id").alias("id"), F.min(F.when(F.col("_n") > 1, F.col("id"))).alias("_repeated")
    )
    unique = F.coalesce(F.col("article_id").isNotNull() & (F.col("id") != F.coalesce("_repeated", F.col("id") + 1)), F.lit(False))
    single = lowest.filter(unique).select("article_id", "id").hint("shuffle_hash")
    plain = summaries.join(single, ["article_id", "id"], "left_semi")
    crowded = lowest.filter(~unique).select(F.col("article_id").alias("_article"))
    ranked = summaries.join(crowded, F.col("article_id").eqNullSafe(F.col("_article")), "left_semi")
    order = [F.col("id").asc_nulls_last(), *(F.col(c) for c in ("created_at", "model") if c in rest), F.xxhash64(*rest)]
    place = F.row_number().over(W.partitionBy("article_id").orderBy(*order))
    first = ranked.withColumn("_place", place).filter("_place = 1")
    return plain.select("article_id", *rest).unionByName(first.select("article_id", *rest))


def lineage(articles: DataFrame, state: DataFrame, summaries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Articles with state and feature presence; several summaries repeat the article [J5, P18].

    Feature rows always hold their feature, so the presence of a row is the flag and neither texts
    nor vectors are read.
    """
    has_s, has_e = F.lit(True).alias("has_summary"), F.lit(True).alias("has_embedding")
    absent = F.lit(False)
    return (
        articles.select("id", "title")
        .join(state.select(F.col("article_id").alias("id"), "status", "retry_count"), "id", "left")
        .join(summaries.select(F.col("article_id").alias("id"), has_s), "id", "left")
        .join(embeddings.select(F.col("article_id").alias("id"), has_e), "id", "left")
        .select(
            "id", "title", "status", "retry_count",
            F.coalesce("has_summary", absent).alias("has_summary"),
            F.coalesce("has_embedding", absent).alias("has_embedding"),
        )
    )


def fully_processed(articles: DataFrame, summaries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Join rows and distinct articles that have both features [J6].

    Each side is counted per article first, so the result is a sum of products and no join row is
    ever produced for an article with many summaries.
    """
    per_article = summaries.groupBy("article_id").agg(F.count("*").alias("_s"))
    vectors = embeddings.groupBy("article_id").agg(F.count("*").alias("_e"))
    matched = (
        articles.select(F.col("id").alias("article_id")).join(per_article, "article_id").join(vectors, "article_id")
    )
    return matched.agg(
        F.coalesce(F.sum(F.col("_s") * F.col("_e")), F.lit(0)).alias("join_rows"),
        F.count("*").alias("articles"),
    )


def resolve_sources(entries: DataFrame, sources: DataFrame, url: str = "feed_url") -> DataFrame:
    """Entries with the id of the source their feed URL names; NULL when no source does [J7]."""
    known = sources.select(F.col("url").alias(url), F.col("id").alias("source_id"))
    return entries.join(known, url, "left")


def without_feature(articles: DataFrame, features: DataFrame, model: str | None = None) -> DataFrame:
    """Articles still lacking a feature, optionally one made by ``model`` [D6, U3]."""
    done = features if model is None else features.filter(F.col("model") == model)
    return articles.join(done.select(F.col("article_id").alias("id")), "id", "left_anti")


def missing_features(articles: DataFrame, summaries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, feature) for every feature an article lacks: the work still to do [U3]."""
    have = (
        articles.select("id")
        .join(summaries.select(F.col("article_id").alias("id"), F.lit(True).alias("_s")).distinct(), "id", "left")
        .join(embeddings.select(F.col("article_id").alias("id"), F.lit(True).alias("_e")).distinct(), "id", "left")
    )
    lacking = F.array_compact(
        F.array(
            F.when(F.col("_s").isNull(), F.lit("summary")),
            F.when(F.col("_e").isNull(), F.lit("embedding")),
        )
    )
    return have.select("id", F.explode(lacking).alias("feature"))


def with_page_text(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries with ``content``: the landed page's text, else the feed summary [S6]."""
    texts = pages.select("url", "page_text")
    return (
        entries.join(texts, "url", "left")
        .withColumn("content", F.coalesce(present(F.col("page_text")), F.col("summary")))
        .drop("page_text")
    )
