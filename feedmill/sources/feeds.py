"""Landed RSS and Atom documents -> feed entries.

One landed row holds one feed document.  Parsing is Spark's ``from_xml`` with an explicit schema
that covers both dialects; an unreadable document yields no entries and is reported apart.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedmill import fixed_values as fv, schemas
from feedmill.functions.dates import feed_date
from feedmill.functions.urls import (
    channel_feed_url, channel_id, channel_id_from_page, is_channel_page, is_feed_url, video_id,
)
from feedmill.operators.filters import published_within
from feedmill.operators.joins import with_page_text
from feedmill.sources.pages import first_landed

_BAD = "_bad_document"
_ITEM = "title string, link string, description string, pubDate string, updated string, `dc:date` string"
_ENTRY = (
    "title string, link array<struct<_href: string, _rel: string>>, published string, updated string, "
    "summary string, content string, `yt:videoId` string, "
    "`media:group` struct<`media:description`: string>"
)
FEED_DOCUMENT = f"channel struct<item: array<struct<{_ITEM}>>>, entry array<struct<{_ENTRY}>>, {_BAD} string"


def landed_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Feed documents landed as files, one row per file (feed_url is the file's path)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.input_file_name().alias("feed_url"), F.col("value").alias("xml"))


def _document(landed: DataFrame) -> DataFrame:
    parsed = F.from_xml(F.col("xml"), FEED_DOCUMENT, {"columnNameOfCorruptRecord": _BAD})
    return landed.withColumn("_doc", parsed)


def unreadable_feeds(landed: DataFrame) -> DataFrame:
    """Feed documents that are not well-formed; they contribute no entries [S1]."""
    return _document(landed).filter(F.col(f"_doc.{_BAD}").isNotNull() | F.col("_doc").isNull()).select("feed_url")


def _entry(item: Column) -> Column:
    return F.struct(
        item["title"].alias("title"),
        item["link"].alias("url"),
        item["pubDate"].alias("published"),
        F.coalesce(item["updated"], item["dc:date"]).alias("updated"),
        item["description"].alias("summary"),
        F.lit(None).cast("string").alias("video_id"),
    )


def _atom_entry(entry: Column) -> Column:
    links = entry["link"]
    alternate = F.filter(links, lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    return F.struct(
        entry["title"].alias("title"),
        F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"]).alias("url"),
        entry["published"].alias("published"),
        entry["updated"].alias("updated"),
        F.coalesce(entry["summary"], entry["content"], entry["media:group"]["media:description"]).alias("summary"),
        entry["yt:videoId"].alias("video_id"),
    )


def feed_entries(landed: DataFrame, use_updated: bool = False) -> DataFrame:
    """One row per entry with the defaults for missing fields [S1]; with ``use_updated`` the update
    date stands in for a missing publication date [S3].

    Other columns of ``landed`` travel along.  ``entry_seq`` is the entry's place in its document.
    The outer explode keeps Spark from inferring a size filter that would parse every document twice.
    """
    carried = [c for c in landed.columns if c != "xml"]
    none = F.array().cast("array<struct<title:string,url:string,published:string,updated:string,summary:string,video_id:string>>")
    items = F.coalesce(F.transform(F.col("_doc.channel.item"), _entry), none)
    entries = F.coalesce(F.transform(F.col("_doc.entry"), _atom_entry), none)
    rows = (
        _document(landed)
        .select(*carried, F.concat(items, entries).alias("_all"))
        .select(*carried, F.posexplode_outer("_all").alias("entry_seq", "_e"))
        .filter(F.col("_e").isNotNull())
    )
    published = feed_date(F.col("_e.published"))
    if use_updated:
        published = F.coalesce(published, feed_date(F.col("_e.updated")))
    return rows.select(
        *carried,
        "entry_seq",
        F.coalesce("_e.title", F.lit(fv.NO_TITLE)).alias("title"),
        F.coalesce("_e.url", F.lit("")).alias("url"),
        published.alias("published_at"),
        F.coalesce("_e.summary", F.lit("")).alias("summary"),
        F.col("_e.video_id").alias("video_id"),
    )


def recent_entries(entries: DataFrame, as_of: datetime | str, hours: float | None) -> DataFrame:
    """Entries of the window, undated ones kept; no window when ``hours`` is None [P3]."""
    return entries if hours is None else published_within(entries, as_of, hours, keep_undated=True)


def tagged_entries(landed: DataFrame, categories: DataFrame, use_updated: bool = False) -> DataFrame:
    """Entries of the feeds listed in ``categories`` (feed_url, category), tagged [S2].

    A feed that is missing or unreadable yields nothing and stops no other feed.
    """
    listed = landed.join(categories, "feed_url")
    return feed_entries(listed, use_updated)


def channel_feeds(channels: DataFrame, url: str = "url", pages: DataFrame | None = None) -> DataFrame:
    """Channels with the feed URL to read: built from the channel id, else the URL itself [S4].

    ``pages`` (url, html) resolves handle and name URLs.  The few such URLs meet the landed pages in
    an inner join, so the pages are streamed past them, and only ids come back.
    """
    named = channels.withColumn("channel_id", channel_id(F.col(url)))
    if pages is not None:
        handles = named.filter(is_channel_page(F.col(url))).select(F.col(url).alias("url")).distinct()
        landed = pages.join(handles, "url").withColumn("_in_page", channel_id_from_page(F.col("html"))).drop("html")
        found = first_landed(landed, "_in_page").withColumnRenamed("url", url)
        named = named.join(found, url, "left").withColumn("channel_id", F.coalesce("channel_id", "_in_page")).drop("_in_page")
    return named.withColumn("feed_url", F.coalesce(channel_feed_url(F.col("channel_id")), F.col(url)))


def channel_entries(landed: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """Video entries with their id and, when given, transcript [S4].

    ``transcripts`` holds (video_id, content) with one row per video.
    """
    entries = feed_entries(landed)
    videos = entries.withColumn("video_id", F.coalesce(video_id(F.col("url")), F.col("video_id")))
    if transcripts is None:
        return videos.withColumn("transcript", F.lit(None).cast("string"))
    return videos.join(transcripts.select("video_id", F.col("content").alias("transcript")), "video_id", "left")


def blog_routes(sources: DataFrame, url: str = "url") -> DataFrame:
    """Blog sources with ``route`` feed or page [S5]."""
    return sources.withColumn("route", F.when(is_feed_url(F.col(url)), F.lit("feed")).otherwise(F.lit("page")))


def blog_entries(landed: DataFrame, pages: DataFrame) -> DataFrame:
    """Blog feed entries whose content is the landed page's text, else the summary [S6]."""
    return with_page_text(feed_entries(landed), first_landed(pages, "page_text"))


def to_bronze(entries: DataFrame) -> DataFrame:
    """Entries in the one bronze shape shared by all origins."""
    have = set(entries.columns)
    return entries.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.FEED_ENTRIES.fields
        ]
    )
