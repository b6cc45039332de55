"""Digests and deliveries.

A digest is a table of ordered items; its body is written as ordered parts, never assembled in one
task.  Deliveries are one row per subscriber that points at the digest: the items are rendered once,
not once per subscriber.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from feedmill import fixed_values as fv
from feedmill.functions.dates import literal_time, long_date, short_date
from feedmill.functions.text import best_text, display_name, escape_html, prompt_entry, short_prompt, subject_line
from feedmill.functions.urls import subscriber_link, valid_email
from feedmill.operators.filters import active_rows, published_within, scraped_within
from feedmill.operators.joins import with_source, with_summaries
from feedmill.operators.ranking import newest_first, running_total, top_per_group
from feedmill.operators.scoring import OFFLINE_MODEL, Scorer, longest_sentences, score
from feedmill.session import staged

BRAND = "Daily News Digest"
BASE_URL = fv.LINK_BASE_URL
RULE = "-" * 80
DOUBLE_RULE = "=" * 80


def digest(
    articles: DataFrame,
    summaries: DataFrame,
    sources: DataFrame,
    as_of: datetime | str,
    hours: float = fv.DEFAULT_HOURS_BACK,
    source_name: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Published, summarised articles of the window, newest first [M1]; of one source name [M3].

    The window's slim article rows are staged, so the planner knows their size: a window that is
    small beside the whole history is broadcast and the summary texts are streamed past it without
    a shuffle; a larger one is joined by shuffle.  ``ordered=False`` leaves out the global sort, which
    Spark prepares by a sampling pass over the join, for callers that count or write parts.
    """
    recent = published_within(articles.select("id", "source_id", "title", "url", "published_at"), as_of, hours)
    named = staged(with_source(recent, sources, source_name), "window")
    rows = digest_rows(with_summaries(named, summaries))
    return rows.orderBy(*newest_first(), "model") if ordered else rows


def digest_rows(joined: DataFrame) -> DataFrame:
    """Digest projection [P17]."""
    return joined.select(
        "id",
        "title",
        "url",
        "published_at",
        long_date(F.col("published_at")).alias("published_date"),
        "source_name",
        "model",
        "summary",
        F.coalesce("key_points", F.array().cast("array<string>")).alias("key_points"),
    )


def top_articles(
    articles: DataFrame,
    sources: DataFrame,
    as_of: datetime | str,
    hours: float = fv.DEFAULT_HOURS_BACK,
    per_source: int = fv.MAX_ARTICLES_PER_SOURCE,
) -> DataFrame:
    """Up to ``per_source`` newest articles per source name scraped in the window [M2 selection]."""
    window = with_source(scraped_within(articles, as_of, hours), sources)
    return top_per_group(window, "source_name", per_source, newest_first())


def scored_digest(
    articles: DataFrame,
    sources: DataFrame,
    as_of: datetime | str,
    hours: float = fv.DEFAULT_HOURS_BACK,
    per_source: int = fv.MAX_ARTICLES_PER_SOURCE,
    scorer: Scorer = longest_sentences,
    model: str = OFFLINE_MODEL,
    system_prompt: str = "",
    prompt_chars: int | None = None,
) -> DataFrame:
    """Top articles scored at read time; failed ones drop out, without replacement [M2].

    Whole contents are scored; ``prompt_chars`` cuts them for scorers that take no more.
    """
    chosen = top_articles(articles, sources, as_of, hours, per_source).select(
        "id", "source_name", "title", "url", "published_at", "content", "position"
    )
    prompt = short_prompt(F.col("title"), F.col("content"), system_prompt, prompt_chars)
    content = best_text(F.col("content"), F.col("title"))
    scored = score(chosen, prompt, scorer, model, content=content).filter(F.coalesce("summary", F.lit("")) != "")
    return chosen.drop("content").join(scored.select(F.col("article_id").alias("id"), "summary"), "id")


def sections(items: DataFrame, order_column: str = "position") -> DataFrame:
    """Items gathered per source name, with the sort keys of the group order [A2].

    ``items`` must already be cut to a few per source (:func:`top_articles`), which bounds the lists.
    Groups appear in the order of their newest item.
    """
    item = F.struct(
        F.col(order_column).alias("position"),
        *[F.col(c) for c in ("id", "title", "url", "published_at", "summary") if c in items.columns],
    )
    return items.groupBy("source_name").agg(
        F.count("*").alias("n_items"),
        F.array_sort(F.collect_list(item)).alias("items"),
        F.min(F.struct(F.col("published_at").isNotNull().alias("dated"), (-_seconds("published_at")).alias("age"),
                       F.col("id").alias("id"))).alias("_first"),
    ).select("source_name", "n_items", "items", "_first")


def _seconds(column: str) -> Column:
    days = F.datediff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)


def section_bodies(grouped: DataFrame) -> DataFrame:
    """(source_name, n_items, text_body, html_body) per section, in group order [X19, X20]."""
    return _rendered(grouped).orderBy("_first").drop("_first")


def _rendered(grouped: DataFrame) -> DataFrame:
    """The section bodies with the key of the group order."""

    def text_item(i: Column) -> Column:
        return F.concat(
            F.lit("\n• "), i["title"],
            F.coalesce(F.concat(F.lit("\n  "), short_date(i["published_at"])), F.lit("")),
            F.lit("\n\n  "), i["summary"], F.lit("\n  Read more: "), i["url"], F.lit("\n"),
        )

    def html_item(i: Column) -> Column:
        return F.concat(
            F.lit('<div><h3><a href="'), i["url"], F.lit('">'), i["title"], F.lit("</a></h3>"),
            F.coalesce(F.concat(F.lit("<small>"), short_date(i["published_at"]), F.lit("</small>")), F.lit("")),
            F.lit("<p>"), i["summary"], F.lit('</p><a href="'), i["url"], F.lit('">Read more →</a></div>'),
        )

    head = F.concat(F.lit("\n📰 "), F.upper("source_name"), F.lit("\n" + "-" * 60 + "\n"))
    return grouped.select(
        "source_name",
        "n_items",
        F.concat(head, F.array_join(F.transform("items", text_item), "\n")).alias("text_body"),
        F.concat(
            F.lit("<h2>📰 "), F.col("source_name"), F.lit("</h2>"),
            F.array_join(F.transform("items", html_item), ""),
        ).alias("html_body"),
        "_first",
    )


def digest_body(grouped: DataFrame, as_of: datetime | str, brand: str = BRAND) -> DataFrame:
    """The whole body of a digest by sections as parts, with its header and footer [M2, X19, X20].

    Rows are (part, source_name, n_items, text_start, text_part, html_start, html_part): opening, the sections in group
    order, closing.  The parts by their start are the body; starts are prefix sums over slim rows, so no task
    gathers the body.  Without sections the body is opening and closing; a source without a name has no section.
    """
    bar, day = "=" * 60, long_date(literal_time(as_of))
    opening_text = F.concat(F.lit(f"{bar}\n{brand.upper()}\n"), day, F.lit(f"\n{bar}\n\n"))
    opening_html = F.concat(F.lit(f"<h1>🗞 {brand}</h1><p>"), day, F.lit("</p><hr>"))
    closing_text, closing_html = f"\n{bar}\n{fv.GENERATED_TEXT_NOTE}{brand}\n{bar}", f"<hr><p>{fv.GENERATED_HTML_NOTE}{brand}</p>"
    rendered = _rendered(grouped).filter("source_name IS NOT NULL").select(
        "source_name", "n_items", "_first", F.concat("text_body", F.lit("\n")).alias("text_part"), F.col("html_body").alias("html_part")
    )
    sized = rendered.withColumn("_text", F.length("text_part")).withColumn("_html", F.length("html_part"))
    kept = staged(sized, "bodies")
    slim = kept.select("source_name", "_first", "_text", "_html")
    slim = running_total(slim, [F.col("_first")], "_text", "text_start")
    starts = running_total(slim, [F.col("_first")], "_html", "html_start").select("source_name", "text_start", "html_start")
    none, zero = F.lit(None).cast("string").alias("source_name"), F.lit(0).cast("bigint")
    body = kept.join(starts, "source_name").select(
        F.lit("section").alias("part"), "source_name", "n_items",
        (F.col("text_start") + F.length(opening_text)).alias("text_start"), "text_part",
        (F.col("html_start") + F.length(opening_html)).alias("html_start"), "html_part",
    )
    opening = kept.sparkSession.range(1).select(
        F.lit("opening").alias("part"), none, zero.alias("n_items"),
        zero.alias("text_start"), opening_text.alias("text_part"), zero.alias("html_start"), opening_html.alias("html_part"),
    )
    end = lambda size, before: (F.coalesce(F.sum(size), zero) + F.length(before)).cast("bigint")
    closing = kept.agg(end("_text", opening_text).alias("text_start"), end("_html", opening_html).alias("html_start")).select(
        F.lit("closing").alias("part"), none, zero.alias("n_items"),
        "text_start", F.lit(closing_text).alias("text_part"), "html_start", F.lit(closing_html).alias("html_part"),
    )
    return opening.unionByName(body).unionByName(closing)


def digest_totals(items: DataFrame) -> DataFrame:
    """{total_articles, total_sources, success} of a digest [A14]."""
    return items.agg(
        F.count("*").alias("total_articles"),
        F.count_distinct("source_name").alias("total_sources"),
        (F.count("*") > 0).alias("success"),
    )


def source_prompts(chosen: DataFrame) -> DataFrame:
    """(source_name, n_items, prompt_section) of the digest prompt [X16, W3].

    ``chosen`` is the output of :func:`top_articles`: numbered and cut per source.
    """
    return _prompt_sections(chosen).select("source_name", "n_items", "prompt_section")


def _prompt_sections(chosen: DataFrame) -> DataFrame:
    """The prompt sections with the time and id of their first item, which order them."""
    entry = prompt_entry(F.col("position"), F.col("title"), F.col("url"), F.col("content"))
    first = F.struct("published_at", "id")
    numbered = chosen.select("source_name", first.alias("first"), F.struct("position", entry.alias("entry")).alias("e"))
    grouped = numbered.groupBy("source_name").agg(
        F.count("*").alias("n_items"),
        F.array_sort(F.collect_list("e")).alias("entries"),
        F.min_by("first", "e.position").alias("first"),
    )
    return grouped.select(
        "source_name",
        "n_items",
        F.concat(
            F.lit("\n## "), F.col("source_name"), F.lit("\n\n"),
            F.array_join(F.transform("entries", lambda e: e["entry"]), "\n"),
        ).alias("prompt_section"),
        "first.published_at",
        "first.id",
    )


def digest_prompt(chosen: DataFrame) -> DataFrame:
    """The whole digest prompt as parts (part, source_name, n_items, start, text) [X16].

    Parts are the opening, one section per source in the order of the sources' newest items, and the closing; ``start``
    is the character at which the part begins, so the texts by ``start`` are the prompt and any writer can put a part
    in its place.  Starts are prefix sums over slim (order, length) rows; no task gathers the text.  Without sections the
    prompt is opening and closing; a source without a name has no section.
    """
    head = fv.DIGEST_PROMPT_HEAD + "\n\n"
    sections = _prompt_sections(chosen).filter("prompt_section IS NOT NULL")
    sections = sections.withColumn("text", F.concat("prompt_section", F.lit("\n"))).withColumn("_size", F.length("text"))
    kept = staged(sections.select("source_name", "n_items", "text", "_size", "published_at", "id"), "sections")
    starts = running_total(kept.select("source_name", "_size", "published_at", "id"), newest_first(), "_size", "start")
    body = kept.join(starts.select("source_name", "start"), "source_name").select(
        F.lit("section").alias("part"), "source_name", "n_items", (F.col("start") + len(head)).alias("start"), "text"
    )
    nothing = F.lit(None).cast("string").alias("source_name"), F.lit(0).cast("bigint").alias("n_items")
    total = F.coalesce(F.sum("_size"), F.lit(0)).cast("bigint")
    closing = kept.agg(
        (total + len(head)).alias("start"), F.when(total > 0, F.lit("\n")).otherwise(F.lit("\n\n")).alias("gap")
    ).select(F.lit("closing").alias("part"), *nothing, "start", F.concat("gap", F.lit(fv.DIGEST_PROMPT_TAIL)).alias("text"))
    opening = kept.sparkSession.range(1).select(
        F.lit("opening").alias("part"), *nothing, F.lit(0).cast("bigint").alias("start"), F.lit(head).alias("text")
    )
    return opening.unionByName(body).unionByName(closing)


def write_prompt(parts: DataFrame, path: str) -> None:
    """Write the prompt as text files whose order is the order of the parts; the last line ends in a line end."""
    line = F.regexp_replace("text", "\n\\z", "")  # the writer ends every row with one
    parts.orderBy("start").select(line.alias("text")).write.mode("errorifexists").text(path)


# --- rendering ----------------------------------------------------------------------------


def item_text(title: Column, url: Column, source: Column, date: Column, summary: Column, points: Column) -> Column:
    """Plain-text block of one item, with key insights when there are any [X20]."""
    insights = F.when(
        F.size(points) > 0,
        F.concat(
            F.lit("\n\nKey Insights:\n"),
            F.array_join(F.transform(points, lambda p: F.concat(F.lit("  • "), p)), "\n"),
        ),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"{RULE}\n"), title, F.lit("\n"), url, F.lit("\n\nSource: "), source, F.lit(" | Published: "), date,
        F.lit("\n\n"), summary, insights, F.lit("\n"),
    )


def item_html(title: Column, url: Column, source: Column, date: Column, summary: Column, points: Column) -> Column:
    """HTML block of one item; every value is escaped [X19]."""
    e = escape_html
    insights = F.when(
        F.size(points) > 0,
        F.concat(
            F.lit("<h3>Key Insights</h3><ul>"),
            F.array_join(F.transform(points, lambda p: F.concat(F.lit("<li>"), e(p), F.lit("</li>"))), ""),
            F.lit("</ul>"),
        ),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit('<div class="article"><h2><a href="'), e(url), F.lit('">'), e(title), F.lit("</a></h2><div>"),
        e(source), F.lit(" • "), e(date), F.lit("</div><p>"), e(summary), F.lit("</p>"), insights, F.lit("</div>"),
    )


def digest_parts(items: DataFrame) -> DataFrame:
    """Rendered items, one row per item; sorted by (published_at desc, id, model) they are the body."""
    fields = [F.col(c) for c in ("title", "url", "source_name", "published_date", "summary", "key_points")]
    return items.select(
        "id", "model", "published_at", item_text(*fields).alias("text_part"), item_html(*fields).alias("html_part")
    )


def write_body(parts: DataFrame, path: str, column: str = "text_part") -> None:
    """Write the body as ordered text files: range-partitioned by position, so file order is item
    order and no task holds the whole digest."""
    parts.orderBy(*newest_first(), "model").select(column).write.mode("errorifexists").text(path)


def deliveries(
    subscribers: DataFrame,
    items: DataFrame,
    as_of: datetime | str,
    brand: str = BRAND,
    base_url: str = BASE_URL,
) -> DataFrame:
    """One row per active subscriber: address, links, opening and closing of both bodies, outcome [M4, J11, X19, X20].

    The digest is counted once by a scalar subquery; no subscriber is ever paired with items.  An
    empty digest is not sent.
    """
    count = items.agg(F.count("*").alias("n")).scalar()
    return delivery_rows(subscribers.withColumn("articles_count", count), as_of, brand, base_url)


def delivery_rows(counted: DataFrame, as_of: datetime | str, brand: str, base_url: str, extra: Sequence[str] = ()) -> DataFrame:
    """The deliveries of subscribers with their ``articles_count``; ``extra`` columns go along."""
    counted = active_rows(counted, "is_active")
    day = long_date(literal_time(as_of))
    email = F.col("email")
    valid = valid_email(email)
    status = F.when((F.col("articles_count") > 0) & valid, F.lit("sent")).otherwise(F.lit("failed"))
    links = [(label, subscriber_link(email, action, base_url)) for label, action in (
        (fv.UNSUBSCRIBE_LABEL, "unsubscribe"), (fv.PREFERENCES_LABEL, "preferences"))]
    anchors = [F.concat(F.lit('<a href="'), escape_html(link), F.lit(f'">{label}</a>')) for label, link in links]
    title = escape_html(F.lit(brand))
    return counted.select(
        F.col("id").alias("subscription_id"),
        "email",
        F.coalesce(F.nullif("name", F.lit("")), F.lit(fv.DEFAULT_READER)).alias("reader"),
        subject_line(as_of, brand).alias("subject"),
        F.concat(
            F.lit(f"{brand.upper()}\n"), day, F.lit(f"\n{DOUBLE_RULE}\n\n"),
            F.col("articles_count").cast("string"), F.lit(f"{fv.ARTICLES_NOTE}\n\n"),
        ).alias("text_head"),
        F.concat(
            F.lit(f"{DOUBLE_RULE}\n\n{fv.SUBSCRIBED_NOTE}{brand}\n\n"),
            *[F.concat(F.lit(f"{label}: "), link, F.lit("\n")) for label, link in links],
        ).alias("text_tail"),
        F.concat(
            F.lit('<!DOCTYPE html><html><head><meta charset="UTF-8"><title>'), title,
            F.lit('</title></head><body><div class="container"><div class="header"><h1>'), title, F.lit("</h1><p>"), day,
            F.lit('</p></div><div class="content"><div class="summary"><p><strong>'),
            F.col("articles_count").cast("string"), F.lit(f"</strong>{fv.ARTICLES_NOTE}</p></div>"),
        ).alias("html_head"),
        F.concat(
            F.lit(f'</div><div class="footer"><p>{fv.SUBSCRIBED_NOTE}'), title, F.lit("</p><p>"),
            F.concat_ws(" • ", *anchors), F.lit("</p></div></div></body></html>"),
        ).alias("html_tail"),
        "articles_count",
        status.alias("status"),
        F.when(F.col("articles_count") == 0, F.lit("No articles found"))
        .when(~valid, F.lit("Invalid email address"))
        .alias("error_message"),
        literal_time(as_of).alias("sent_at"),
        *extra,
    )


def ad_hoc_reader(emails: DataFrame) -> DataFrame:
    """Addresses outside the subscriptions, named after their local part [X22]."""
    return emails.select("email", display_name(F.col("email")).alias("name"))
