"""Ingest: landed feeds and pages of the active sources -> labelled new articles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from feedmill.functions.dates import cutoff, literal_time
from feedmill.functions.urls import video_id
from feedmill.operators.aggregates import ingest_stats
from feedmill.operators.dedup import absent_keys, label_candidates
from feedmill.operators.filters import active_rows
from feedmill.operators.joins import resolve_sources
from feedmill.session import staged
from feedmill.sources.feeds import blog_routes, channel_feeds, feed_entries
from feedmill.sources.pages import first_landed, read_page_features

CANDIDATE = ("source_id", "title", "url", "content", "published_at", "video_id", "category", "ingest_seq")
SCANNED_TYPES = ("youtube", "blog")


def _sequence() -> Column:
    """Ingest order: source id, then place in the landed documents; a page source has one row."""
    return F.struct(F.col("source_id"), F.col("feed_seq"), F.col("entry_seq"))


def save_rows(entries: DataFrame, content: Column, category: Column, video: Column | None = None) -> DataFrame:
    """Entries of one origin in article shape [S16]: content or '', the origin's category rule."""
    return entries.select(
        "source_id",
        "title",
        "url",
        F.coalesce(content, F.lit("")).alias("content"),
        "published_at",
        (video if video is not None else F.lit(None).cast("string")).alias("video_id"),
        category.cast("string").alias("category"),
        "ingest_seq",
    )


def save_origin(
    entries: DataFrame, sources: DataFrame, content: Column, category: Column, video: Column | None = None
) -> DataFrame:
    """Rows of one origin under the source its feed URL names [S16, J7]; entries of a feed that no
    source names are skipped as a whole and reported by :func:`unmatched_feeds`."""
    resolved = resolve_sources(entries, sources)
    return save_rows(resolved.filter(F.col("source_id").isNotNull()), content, category, video)


def unmatched_feeds(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(feed_url, skipped) of the feeds without a source [J7].  Entries are counted per feed first."""
    per_feed = entries.groupBy("feed_url").agg(F.count("*").alias("skipped"))
    return absent_keys(per_feed, sources.select(F.col("url").alias("feed_url")), "feed_url")


def scan_sources(
    sources: DataFrame,
    landed_feeds: DataFrame,
    landed_pages: DataFrame,
    as_of: datetime | str,
    hours: float | None = None,
) -> DataFrame:
    """Candidate articles of all active video and blog sources [S14, U1].

    ``landed_feeds`` is (feed_url, feed_seq, xml), ``landed_pages`` (url, html).  Other source types
    are skipped.  Video and blog feeds go through one scan and one parse; the look-back window
    applies to videos only.  Of a page that landed several times the first counts.
    """
    ids = scanned_sources(sources).select(F.col("id").alias("source_id"), "source_type", "url")
    is_video = F.col("source_type") == "youtube"
    channels = channel_feeds(ids.filter(is_video), pages=landed_pages).select("source_id", "source_type", "feed_url")
    blogs = blog_routes(ids.filter(~is_video))
    feeds = blogs.filter(F.col("route") == "feed").select("source_id", "source_type", F.col("url").alias("feed_url"))
    single = blogs.filter(F.col("route") == "page").select("source_id", "url")

    entries = feed_entries(landed_feeds.join(channels.unionByName(feeds), "feed_url"))
    if hours is not None:
        recent = F.col("published_at").isNull() | (F.col("published_at") >= cutoff(as_of, hours))
        entries = entries.filter(~is_video | recent)
    page_rows = (
        read_page_features(first_landed(landed_pages.join(single.select("url").distinct(), "url"), "html").join(single, "url"))
        .withColumn("feed_seq", F.lit(0).cast("long"))
        .withColumn("entry_seq", F.lit(0))
    )
    nothing = F.lit(None).cast("string")
    video = F.when(is_video, F.coalesce(video_id(F.col("url")), F.col("video_id")))
    return save_rows(entries.withColumn("ingest_seq", _sequence()), F.col("summary"), nothing, video).unionByName(
        save_rows(page_rows.withColumn("ingest_seq", _sequence()), F.col("page_text"), nothing)
    )


def resolve_category(entries: DataFrame, category_feeds: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries with ``source_id`` found through category -> feed URL -> source [J7].

    ``resolution`` is ok, ``unknown category`` (skipped) or ``no source`` (an error).
    """
    feeds = category_feeds.select("category", F.col("feed_url").alias("_feed"))
    known = sources.select(F.col("url").alias("_feed"), F.col("id").alias("source_id"))
    joined = entries.join(feeds.join(known, "_feed", "left"), "category", "left")
    return joined.withColumn(
        "resolution",
        F.when(F.col("_feed").isNull(), F.lit("unknown category"))
        .when(F.col("source_id").isNull(), F.lit("no source"))
        .otherwise(F.lit("ok")),
    ).drop("_feed")


def ingest(
    sources: DataFrame,
    landed_feeds: DataFrame,
    landed_pages: DataFrame,
    store: DataFrame,
    as_of: datetime | str,
    hours: float | None = None,
    source_id: int | None = None,
) -> DataFrame:
    """Labelled candidates of all sources, or of one [S14, S15]; only ``created`` rows are stored.

    The parsed candidates are staged, because labelling reads them twice.
    """
    chosen = sources if source_id is None else sources.filter(F.col("id") == source_id)
    candidates = staged(scan_sources(chosen, landed_feeds, landed_pages, as_of, hours), "candidates")
    return label_candidates(candidates, store)


def new_articles(labelled: DataFrame, as_of: datetime | str, first_id: int = 0) -> DataFrame:
    """Created rows in article shape, stamped with the scrape time and numbered from ``first_id``.

    Ids are unique but follow the partitions, so write the rows once and read them back.
    """
    return labelled.filter(F.col("outcome") == "created").select(
        (F.lit(first_id) + F.monotonically_increasing_id()).alias("id"),
        "source_id", "title", "url", "content", "published_at",
        literal_time(as_of).alias("scraped_at"),
        "video_id", "category",
        F.lit("pending").alias("processing_status"),
        F.lit(None).cast("string").alias("full_content"),
        F.lit(None).cast("string").alias("extraction_method"),
    )


def scanned_sources(sources: DataFrame) -> DataFrame:
    """The sources an ingest scans; other types do not count as processed."""
    return active_rows(sources).filter(F.col("source_type").isin(list(SCANNED_TYPES)))


def stats(labelled: DataFrame, sources: DataFrame) -> DataFrame:
    """Statistics row of one ingest [A4]."""
    return ingest_stats(labelled, scanned_sources(sources))
