"""Text expressions: prompts, previews, counts, names and escaping."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from feedmill import fixed_values as fv
from feedmill.functions.dates import literal_time, long_date


def present(text: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(text, F.lit(""))


def best_text(full: Column, short: Column) -> Column:
    """The full text unless missing or empty, else the short one."""
    return F.coalesce(present(full), short)


def truncated(text: Column, limit: int, mark: str = "", always: bool = False) -> Column:
    """At most ``limit`` characters; ``mark`` follows when cut, or always [X13]."""
    cut = F.concat(F.substring(text, 1, limit), F.lit(mark))
    return cut if always else F.when(F.length(text) > limit, cut).otherwise(text)


def _body(content: Column, limit: int | None, mark: str = "") -> Column:
    return content if limit is None else truncated(content, limit, mark)


def summary_prompt(
    title: Column, content: Column, system_prompt: str = fv.SUMMARY_SYSTEM_PROMPT, limit: int | None = fv.SUMMARY_PROMPT_CHARS
) -> Column:
    """Instructions, title and content for the JSON summary [X14]; the whole content without a ``limit``."""
    return F.concat(
        F.lit(f"{system_prompt}\n\n{fv.SUMMARY_PROMPT_HEAD}\n\nTitle: "),
        F.coalesce(present(title), F.lit(fv.NO_PROMPT_TITLE)),
        F.lit("\n\nContent:\n"),
        _body(content, limit, fv.ELLIPSIS),
        F.lit(f"\n\n{fv.SUMMARY_PROMPT_TAIL}"),
    )


def short_prompt(title: Column, content: Column, system_prompt: str, limit: int | None = fv.SHORT_PROMPT_CHARS) -> Column:
    """Two-to-three sentence prompt of the digest; missing content falls back to the title [X15]."""
    body = F.coalesce(_body(present(content), limit), title)
    return F.concat(
        F.lit(f"{system_prompt}\n\n{fv.SHORT_PROMPT_HEAD}\n\nTitle: "), title,
        F.lit("\nContent: "), body, F.lit("\n\nSummary:"),
    )


def article_prompt(title: Column, content: Column) -> Column:
    """Stand-alone prompt for one article [X15]."""
    return F.concat(
        F.lit(f"{fv.ARTICLE_PROMPT_HEAD}\n\nTitle: "), title, F.lit("\n\nContent:\n"),
        truncated(content, fv.SHORT_PROMPT_CHARS), F.lit(f"{fv.ARTICLE_PROMPT_LENGTH_NOTE}\n\nSummary:"),
    )


def prompt_entry(position: Column, title: Column, url: Column, content: Column) -> Column:
    """One numbered entry of the digest prompt with its preview [X16]."""
    return F.concat(
        position.cast("string"), F.lit(". **"), title, F.lit("**\n   URL: "), url,
        F.lit("\n   Content preview: "),
        truncated(content, fv.PREVIEW_CHARS, fv.ELLIPSIS, always=True), F.lit("\n"),
    )


def snippet(title: Column, summary: Column, url: Column) -> Column:
    """Markdown snippet of one item [X18]."""
    return F.format_string(fv.SNIPPET_FORMAT, title, summary, url)


def escape_html(text: Column) -> Column:
    """Escape the five markup characters; ``&`` first so nothing is escaped twice [X19]."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def display_name(email: Column) -> Column:
    """Local part with the first letter upper and the rest lower case [X22]."""
    local = F.substring_index(email, "@", 1)
    return F.concat(F.upper(F.substring(local, 1, 1)), F.lower(F.substr(local, F.lit(2))))


def word_count(text: Column) -> Column:
    """Number of white-space separated words [X23]."""
    return F.regexp_count(text, F.lit(r"\S+"))


def subject_line(as_of: datetime | str, brand: str) -> Column:
    """Mail subject carrying the run date [X24]."""
    return F.concat(F.lit(f"{brand} - "), long_date(literal_time(as_of)))
