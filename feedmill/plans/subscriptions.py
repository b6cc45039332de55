"""Deliveries that keep to their subscribers' source filters, and their log [J11, M4].

Subscribers share few filters.  Each different filter is a canonical set of source ids, settled once: an inverted index from
source to sets meets the digest's articles grouped by source, so a set's articles are counted from a row per source and
named once per set, and subscribers join by set.  No subscriber is ever paired with articles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from feedmill import fixed_values as fv
from feedmill.functions.dates import literal_time
from feedmill.operators.filters import active_rows, published_within
from feedmill.plans import digests
from feedmill.session import staged

#: The set of subscribers without a filter: every source.
ALL_SOURCES = ""
#: Deliveries of one set that meet a copy of its list of articles.
DELIVERIES_PER_SLOT = 4096


def canonical_filter(filters: Column) -> Column:
    """A filter as text: its different ids in order; null, empty and all-null filters take every source."""
    ids = F.array_sort(F.array_distinct(F.filter(filters, lambda i: i.isNotNull())))
    return F.coalesce(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), F.lit(ALL_SOURCES))


def digest_keys(articles: DataFrame, summaries: DataFrame, sources: DataFrame, as_of: datetime | str, hours: float = fv.DEFAULT_HOURS_BACK) -> DataFrame:
    """(id, model, source_id) of a digest's items: keys only, as counting and naming need no texts."""
    recent = published_within(articles.select("id", "source_id", "published_at"), as_of, hours)
    known = recent.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return known.join(summaries.select(F.col("article_id").alias("id"), "model"), "id").select("id", "model", "source_id")


def filter_index(subscribers: DataFrame) -> DataFrame:
    """(filter_set, source_id) of every different filter of an active subscriber; the set of all sources has no rows."""
    sets = active_rows(subscribers, "is_active").select(canonical_filter(F.col("source_filters")).alias("filter_set")).distinct()
    named = sets.filter(F.col("filter_set") != ALL_SOURCES)
    return named.select("filter_set", F.explode(F.split("filter_set", ",").cast("array<bigint>")).alias("source_id"))


def set_counts(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(filter_set, n) of the digest's items in each set; a source with most items is one row before the join."""
    per_source = keys.groupBy("source_id").agg(F.count("*").alias("n"))
    return index.join(per_source, "source_id").groupBy("filter_set").agg(F.sum("n").alias("n"))


def set_articles(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(filter_set, article_id): what each set's deliveries hold, once per set; all sources under their own name."""
    ids = keys.select("source_id", F.col("id").alias("article_id")).distinct()
    everything = ids.select(F.lit(ALL_SOURCES).alias("filter_set"), "article_id")
    return index.join(ids, "source_id").select("filter_set", "article_id").unionByName(everything)


def filtered_deliveries(
    subscribers: DataFrame, keys: DataFrame, as_of: datetime | str, brand: str = digests.BRAND, base_url: str = digests.BASE_URL
) -> DataFrame:
    """One row per active subscriber as :func:`digests.deliveries` gives it, with the count of the subscriber's own sources,
    the filter set, a row id and the time of creation.

    ``subscribers`` have ``source_filters`` (array of source ids).  A set without articles is not sent.
    """
    named = subscribers.withColumn("filter_set", canonical_filter(F.col("source_filters")))
    keys = staged(keys, "digest_keys")
    counts = set_counts(filter_index(subscribers), keys)
    everyone, chosen = named.filter(F.col("filter_set") == ALL_SOURCES), named.filter(F.col("filter_set") != ALL_SOURCES)
    # Subscribers to everything take one number; only the others meet the sets.
    counted = everyone.withColumn("articles_count", keys.agg(F.count("*").alias("n")).scalar()).unionByName(
        chosen.join(counts, "filter_set", "left").withColumn("articles_count", F.coalesce("n", F.lit(0).cast("long"))).drop("n"), allowMissingColumns=False
    )
    rows = digests.delivery_rows(counted, as_of, brand, base_url, extra=["filter_set"])
    return rows.select(F.xxhash64("subscription_id", "sent_at").alias("id"), "*", literal_time(as_of).alias("created_at"))


def _slots(rows: DataFrame) -> DataFrame:
    """(filter_set, slots): into how many stretches the deliveries of a set are cut."""
    sizes = rows.groupBy("filter_set").agg(F.count("*").alias("n"))
    return sizes.select("filter_set", F.ceil(F.col("n") / DELIVERIES_PER_SLOT).cast("int").alias("slots"))


def delivery_log(
    deliveries: DataFrame, articles_of_set: DataFrame, form: Callable[[Column], Column] | None = None, extra: Sequence[str] = ()
) -> DataFrame:
    """Rows of the delivery table with the ids of their articles, for windows whose ids fit a row.

    A list is made once per set, in the ``form`` asked for; larger windows keep (filter_set, article_id) rows instead and
    join by set.  A set of many subscribers meets its list in several stretches, so no task takes all of them, and a list
    joins its delivery last: what moves is slim.  ``extra`` columns of the deliveries go along.
    """
    form = form or (lambda ids: ids)
    lists = articles_of_set.groupBy("filter_set").agg(F.array_sort(F.collect_set("article_id")).alias("ids"))
    lists = lists.select("filter_set", form(F.col("ids")).alias("articles_ids"))
    columns = ["id", "subscription_id", "status", "articles_count", "sent_at", "error_message", "created_at"]
    rows = deliveries.select(*dict.fromkeys([*columns, "filter_set", *extra]))
    slots = _slots(rows)
    copies = lists.join(slots, "filter_set").select("filter_set", "articles_ids", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    dealt = rows.join(slots, "filter_set").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int")).drop("slots")
    # Few subscribers' files mean few tasks, and lists that are broadcast would be copied into their rows there.
    joined = dealt.repartition("filter_set", "slot").join(copies, ["filter_set", "slot"], "left")
    return joined.select(
        "id", "subscription_id", "status", "articles_count",
        F.coalesce("articles_ids", form(F.array().cast("array<bigint>"))).alias("articles_ids"),
        "sent_at", "error_message", "created_at", *[c for c in dict.fromkeys(extra) if c not in columns],
    )
