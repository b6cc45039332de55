"""Quality gates: each adds the text it judged, the verdict and the reason of a rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedmill import fixed_values as fv
from feedmill.functions.text import best_text


def _shorter(text: Column, limit: int) -> Column:
    return text.isNull() | (F.length(text) < limit)


def extraction_gate(articles: DataFrame) -> DataFrame:
    """``next_stage``: summarization when the article is already extracted, else extraction [P9]."""
    extracted = F.coalesce(F.length("full_content") > fv.EXTRACTED_MIN_CHARS, F.lit(False))
    return articles.withColumn("already_extracted", extracted).withColumn(
        "next_stage", F.when(extracted, F.lit("summarization")).otherwise(F.lit("extraction"))
    )


def summary_gate(articles: DataFrame) -> DataFrame:
    """``gate_text``, ``accepted``, ``reason`` for summarization [P10]."""
    text = best_text(F.col("full_content"), F.col("content"))
    rejected = _shorter(F.col("gate_text"), fv.SUMMARY_MIN_CHARS)
    return (
        articles.withColumn("gate_text", text)
        .withColumn("accepted", ~rejected)
        .withColumn("reason", F.when(rejected, F.lit(fv.INSUFFICIENT_CONTENT)))
    )


def embedding_gate(articles: DataFrame, summaries: DataFrame) -> DataFrame:
    """Gate of the embedding stage [P11].

    ``summaries`` holds at most one row per article (see ``one_summary``).  An existing summary
    is taken even when empty; the article text only stands in for a missing row.
    """
    judged = articles.join(
        summaries.select(F.col("article_id").alias("id"), "summary", F.lit(True).alias("has_summary")), "id", "left"
    )
    text = F.when(F.col("has_summary"), F.col("summary")).otherwise(
        best_text(F.col("full_content"), F.col("content"))
    )
    rejected = _shorter(F.col("gate_text"), fv.EMBEDDING_MIN_CHARS)
    return (
        judged.withColumn("gate_text", text)
        .withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))
        .withColumn("accepted", ~rejected)
        .withColumn("reason", F.when(rejected, F.lit(fv.INSUFFICIENT_TEXT)))
    )


def embeddable(text: Column) -> Column:
    """The text, NULL when it holds nothing but white space [P12]."""
    return F.when(text.rlike(r"\S"), text)


def quality_rejects(documents: DataFrame, first_copies: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row (key, rule) per rule a document breaks [P13, documented only].

    Rules: ``too_short``, ``bad_encoding``, ``not_english``, ``duplicate``.  ``first_copies`` holds
    the keys of the first document of every group of equal texts (see ``dedup.first_copies``); the
    join is on that unique key, so a large group of copies stays spread out.
    """
    first = first_copies.select(key, F.lit(True).alias("_first"))
    body = F.col(text)
    broken = F.array_compact(
        F.array(
            F.when(_shorter(body, fv.QUALITY_MIN_CHARS), F.lit("too_short")),
            F.when(~F.is_valid_utf8(body), F.lit("bad_encoding")),
            F.when(~F.col("lang").eqNullSafe("en"), F.lit("not_english")),
        )
    )
    slim = documents.select(key, broken.alias("_rules"))
    flagged = slim.join(first, key, "left").select(
        key,
        F.concat(
            F.col("_rules"), F.when(F.col("_first").isNull(), F.array(F.lit("duplicate"))).otherwise(F.array())
        ).alias("_rules"),
    )
    return flagged.select(key, F.explode("_rules").alias("rule"))


def extraction_route(video_id: Column) -> Column:
    """``transcript`` for videos, ``page`` otherwise [P14]."""
    return F.when(F.coalesce(video_id, F.lit("")) != "", F.lit("transcript")).otherwise(F.lit("page"))


def declared_route(content_type: Column, video_id: Column) -> Column:
    """Route by declared kind; a video without id, or an unknown kind, yields no route [P14]."""
    has_video = F.coalesce(video_id, F.lit("")) != ""
    return F.when((content_type == "video") & has_video, F.lit("transcript")).when(
        content_type == "article", F.lit("page")
    )
