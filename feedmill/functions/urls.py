"""URL and address expressions; every function maps Columns to a Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedmill import fixed_values as fv


def _capture(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured group, NULL instead of Spark's empty string when nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def channel_id(url: Column) -> Column:
    """Channel id named by a feed URL, a channel URL or a bare id, tried in that order [X1]."""
    return (
        F.when(url.contains("channel_id="), F.regexp_extract(url, r"(?s)channel_id=(.*?)(?:channel_id=|&|$)", 1))
        .when(url.contains("/channel/"), F.regexp_extract(url, r"/channel/([^/?]*)", 1))
        .when(url.startswith("UC"), url)
    )


def is_channel_page(url: Column) -> Column:
    """True for handle and name URLs, whose channel id only the landed page tells [X2]."""
    named = F.lit(False)
    for mark in fv.CHANNEL_PAGE_MARKS:
        named = named | url.contains(mark)
    return named & channel_id(url).isNull()


def channel_id_from_page(html: Column) -> Column:
    """Channel id written in a landed channel page: meta tag first, then the script forms [X2]."""
    meta = _capture(html, r"""(?is)<meta\b(?=[^>]*\bitemprop\s*=\s*["']channelId["'])[^>]*\bcontent\s*=\s*["']([^"']+)["']""")
    return F.coalesce(meta, *[_capture(html, p) for p in fv.CHANNEL_ID_IN_PAGE_PATTERNS])


def channel_feed_url(channel: Column) -> Column:
    """Feed URL of a channel id [X3]."""
    return F.concat(F.lit(fv.CHANNEL_FEED_PREFIX), channel)


def video_id(url: Column) -> Column:
    """First 11-character video id any of the known URL shapes yields [X4].

    The first shape accepts any long path segment, so apply this to video sources only.
    """
    return F.coalesce(*[_capture(url, p) for p in fv.VIDEO_ID_PATTERNS])


def is_feed_url(url: Column, declared_feed: Column | None = None) -> Column:
    """Route test: declared as a feed, or ending like one [S5]."""
    looks = declared_feed if declared_feed is not None else F.lit(False)
    for suffix in fv.FEED_URL_SUFFIXES:
        looks = looks | url.endswith(suffix)
    return looks


def canonical_url(url: Column) -> Column:
    """scheme://host/path without trailing slashes, query and fragment [D2, documented only]."""
    shape = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
    path = F.regexp_replace(F.regexp_extract(url, shape, 3), r";[^/]*$", "")
    return F.concat(
        F.lower(F.regexp_extract(url, shape, 1)),
        F.lit("://"),
        F.regexp_extract(url, shape, 2),
        F.regexp_replace(path, r"/+$", ""),
    )


def valid_email(email: Column) -> Column:
    """Address shape test; NULL counts as invalid [P15]."""
    return F.coalesce(email.rlike(fv.EMAIL_PATTERN), F.lit(False))


def subscriber_link(email: Column, action: str, base_url: str) -> Column:
    """Link such as ``unsubscribe`` or ``preferences`` for a subscriber, ``#`` without an address [X21]."""
    return F.when(
        F.coalesce(email, F.lit("")) != "", F.concat(F.lit(f"{base_url}/{action}?email="), email)
    ).otherwise(F.lit(fv.NO_LINK))
