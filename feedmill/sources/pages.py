"""Landed web pages -> title, date and main text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedmill import fixed_values as fv
from feedmill.functions import html


def read_page_features(pages: DataFrame) -> DataFrame:
    """Landed pages with title, published_at and page_text in place of the markup [S7].

    Features nobody selects are pruned together with the function that makes them.
    """
    carried = [c for c in pages.columns if c != "html"]
    dated = pages.withColumn("published_at", html.published_date(F.col("html")))
    return html.with_main_text(html.with_title(dated)).select(*carried, "title", "published_at", "page_text")


def first_landed(pages: DataFrame, value: str, url: str = "url") -> DataFrame:
    """(url, value) of the first landed page per URL: the smallest ``page_id`` where the pages have one, else
    the smallest checksum.  Pages whose value is NULL do not count.  A map-side combined minimum."""
    place = ["page_id"] if "page_id" in pages.columns else []
    order = F.struct(*place, F.xxhash64(value))
    return pages.filter(F.col(value).isNotNull()).groupBy(url).agg(F.min_by(value, order).alias(value))


def extracted_pages(pages: DataFrame) -> DataFrame:
    """(url, title, content, extraction_method) of the extraction stage [X5]."""
    titled = html.with_document_title(pages.select("url", "html"))
    return html.with_plain_text(titled).select(
        "url", "title", "content", F.lit(fv.PAGE_METHOD).alias("extraction_method")
    )
