"""Text, page and response functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill import fixed_values as fv
from feedmill.functions import dates, html, responses, text, urls
from feedmill.operators import gates, scoring
from feedmill.operators.search import accepted_arguments
from feedmill.plans.catalog import query
from feedmill.plans.queries_ingest import ARTICLE_TEXT, _decode
from feedmill.plans.queries_serve import _longest_sql
from feedmill.sources import pages


@query(
    "page_title", "X7",
    "select url, trim(" + _decode("regexp_extract(html, '<h1>([^<]*)</h1>', 1)") + ", E' \\t\\n\\r') as title from pages",
)
def page_title(t):
    return html.with_title(t.landed_pages).select("url", "title")


@query("page_text", "X6 S7", f"select url, {ARTICLE_TEXT} as page_text from pages")
def page_text(t):
    return pages.read_page_features(t.landed_pages).select("url", "page_text")


_NO_SCRIPT = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(?:script|style)>.*?</(?:script|style)>', '{0}', 'g')"
_TITLE = _decode("regexp_extract(html, '<title>([^<]*)</title>', 1)")
_PLAIN = (
    "array_to_string(list_filter(list_transform(regexp_split_to_array("
    + _decode(rf"regexp_replace({_NO_SCRIPT.format('')}, '<[a-zA-Z/!][^>]*>', '', 'g')")
    + r", '\n|  '), lambda x: trim(x, E' \t\n\r')), lambda x: x <> ''), E'\n')"
)


@query("page_plain_text", "X5", f"select url, {_TITLE} as title, {_PLAIN} as content, 'beautifulsoup' as extraction_method from pages")
def page_plain_text(t):
    return pages.extracted_pages(t.landed_pages)


@query(
    "page_dates", "X8",
    """select page_id, case when page_id % 3 = 0 then timestamp '2024-01-01 00:00:00' + to_hours(cast(page_id as int))
         when page_id % 3 = 1 then timestamp '2024-01-01 00:00:00' + to_hours(cast(page_id as int) - 2) end as published_at from pages""",
)
def page_dates(t):
    """Pages dated by a meta tag with Z, by a time element with an offset after a bad meta date, or not at all."""
    stamp = F.date_format(
        F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("page_id").cast("int")),
        "yyyy-MM-dd'T'HH:mm:ss",
    )
    kind = F.col("page_id") % 3
    tag = (
        F.when(kind == 0, F.concat(F.lit('<meta content="'), stamp, F.lit('Z" property="article:published_time">')))
        .when(kind == 1, F.concat(F.lit('<meta property="article:published_time" content="soon"><time datetime="'), stamp, F.lit('+02:00">')))
        .otherwise(F.lit('<meta name="publish_date" content="yesterday">'))
    )
    return t.pages.select("page_id", html.published_date(F.concat(tag, "html")).alias("published_at"))


@query(
    "snippet_text", "X9",
    r"""select page_id, array_to_string(list_filter(list_transform(regexp_split_to_array("""
    + _NO_SCRIPT.format("<b>")
    + r""", '<[a-zA-Z/!][^>]*>'), lambda x: trim("""
    + _decode("x")
    + r""", E' \t\n\r')), lambda x: x <> ''), ' ') as content, 'rss_parse' as method from pages""",
)
def snippet_text(t):
    return html.with_snippet_text(t.pages, "html", "content").select(
        "page_id", "content", html.snippet_method(F.col("html")).alias("method")
    )


def _markdown_sql() -> str:
    text = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "nav", "footer", "head"):
        text = rf"regexp_replace({text}, '(?s)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    text = rf"regexp_replace({text}, '\s+', ' ', 'g')"
    text = rf"regexp_replace({text}, '\s*<h1\b[^>]*>\s*', E'\n\n# ', 'g')"
    text = rf"regexp_replace({text}, '\s*<li\b[^>]*>\s*', E'\n- ', 'g')"
    text = rf"regexp_replace({text}, '\s*<br\b[^>]*>\s*', E'\n', 'g')"
    text = rf"regexp_replace({text}, '\s*</?(?:p|div|article|section|main|ul|ol|h[1-6]|body|html)\b[^>]*>\s*', E'\n\n', 'g')"
    text = _decode(f"regexp_replace({text}, '<[a-zA-Z/!?][^>]*>', '', 'g')")
    return rf"trim(regexp_replace({text}, '\n\n+', E'\n\n', 'g'), E' \t\n\r')"


@query("page_markdown", "X10", f"select page_id, {_markdown_sql()} as markdown from pages")
def page_markdown(t):
    return html.with_markdown(t.pages).select("page_id", "markdown")


_CHANNEL = "concat('UC', substr(md5(cast(doc_id as varchar)), 1, 22))"


@query(
    "channel_ids", "X1 X3",
    f"""select doc_id, case when lang <> 'es' then {_CHANNEL} end as channel_id,
      case when lang <> 'es' then concat('https://www.youtube.com/feeds/videos.xml?channel_id=', {_CHANNEL}) end as feed_url
    from documents""",
)
def channel_ids(t):
    """Every document names a channel in one of the known URL shapes, Spanish ones by an unresolvable handle."""
    channel = F.concat(F.lit("UC"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 22))
    lang = F.col("lang")
    url = (
        F.when(lang == "en", F.concat(F.lit("https://www.youtube.com/feeds/videos.xml?channel_id="), channel, F.lit("&hl=en")))
        .when(lang == "fr", F.concat(F.lit("https://www.youtube.com/channel/"), channel, F.lit("/videos?view=0")))
        .when(lang == "de", channel)
        .otherwise(F.concat(F.lit("https://www.youtube.com/@"), channel))
    )
    found = urls.channel_id(url)
    return t.documents.select("doc_id", found.alias("channel_id"), urls.channel_feed_url(found).alias("feed_url"))


@query(
    "channel_ids_in_pages", "X2",
    f"select doc_id, case when lang <> 'es' then {_CHANNEL} end as channel_id from documents",
)
def channel_ids_in_pages(t):
    channel = F.concat(F.lit("UC"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 22))
    lang = F.col("lang")
    mark = (
        F.when(lang == "en", F.concat(F.lit('<meta itemprop="channelId" content="'), channel, F.lit('">')))
        .when(lang == "fr", F.concat(F.lit('<script>{"channelId":"'), channel, F.lit('"}</script>')))
        .when(lang == "de", F.concat(F.lit('<script>{"externalId":"'), channel, F.lit('"}</script>')))
        .otherwise(F.lit("<p></p>"))
    )
    page = F.concat(F.lit("<html><body><p>"), text.escape_html(F.col("text")), F.lit("</p>"), mark, F.lit("</body></html>"))
    return t.documents.select("doc_id", urls.channel_id_from_page(page).alias("channel_id"))


@query("video_ids", "X4", "select id, video_id from articles where video_id is not null", "articles")
def video_ids(t):
    videos = t.articles.filter(F.col("url").startswith("https://www.youtube.com/"))
    return videos.select("id", urls.video_id(F.col("url")).alias("video_id"))


@query(
    "feed_dates", "X11",
    """select event_id, date_trunc('second', ts) - to_hours(2) as rfc_offset, date_trunc('second', ts) as rfc_zone,
      date_trunc('second', ts) as iso, cast(null as timestamp) as unreadable from events""",
)
def feed_dates(t):
    rfc = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    return t.events.select(
        "event_id",
        dates.feed_date(F.concat(rfc, F.lit(" +0200"))).alias("rfc_offset"),
        dates.feed_date(F.concat(rfc, F.lit(" GMT"))).alias("rfc_zone"),
        dates.feed_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"),
        dates.feed_date(F.concat(F.lit("some day "), F.col("props"))).alias("unreadable"),
    )


@query(
    "date_formats", "X12 X18",
    """select event_id, date_trunc('second', ts) as wall_time, strftime(ts, '%B %d, %Y') as long_date,
      strftime(ts, '%b %d, %Y') as short_date from events""",
)
def date_formats(t):
    zoned = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00"))
    return t.events.select(
        "event_id", dates.iso_wall_time(zoned).alias("wall_time"), dates.long_date(F.col("ts")).alias("long_date"),
        dates.short_date(F.col("ts")).alias("short_date"),
    )


@query(
    "truncations", "X13",
    """select doc_id, case when length(text) > 25000 then substr(text, 1, 25000) || '...' else text end as for_summary,
      substr(text, 1, 5000) as for_embedding, substr(text, 1, 300) || '...' as preview from documents""",
)
def truncations(t):
    body = F.col("text")
    return t.documents.select(
        "doc_id",
        text.truncated(body, fv.SUMMARY_PROMPT_CHARS, fv.ELLIPSIS).alias("for_summary"),
        text.truncated(body, fv.EMBEDDING_CHARS).alias("for_embedding"),
        text.truncated(body, fv.PREVIEW_CHARS, fv.ELLIPSIS, always=True).alias("preview"),
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SUMMARY_PROMPT = (
    f"concat({_sql_text(fv.SUMMARY_SYSTEM_PROMPT)}, E'\\n\\n{fv.SUMMARY_PROMPT_HEAD}\\n\\nTitle: ', coalesce(nullif(title, ''), 'N/A'), "
    "E'\\n\\nContent:\\n', case when length(content) > 25000 then substr(content, 1, 25000) || '...' else content end, "
    f"E'\\n\\n{fv.SUMMARY_PROMPT_TAIL}')"
)


@query(
    "summary_prompts", "X14",
    f"select id, {SUMMARY_PROMPT} as prompt from (select id, case when category = 'es' then '' else title end as title, content from articles) a",
    "articles",
)
def summary_prompts(t):
    title = F.when(F.col("category") == "es", F.lit("")).otherwise(F.col("title"))
    return t.articles.select("id", text.summary_prompt(title, F.col("content")).alias("prompt"))


@query(
    "short_prompts", "X15",
    f"""select id, concat('Be brief.', E'\\n\\n{fv.SHORT_PROMPT_HEAD}\\n\\nTitle: ', title, E'\\nContent: ',
        coalesce(substr(nullif(content, ''), 1, 2000), title), E'\\n\\nSummary:') as short_prompt,
      concat({_sql_text(fv.ARTICLE_PROMPT_HEAD)}, E'\\n\\nTitle: ', title, E'\\n\\nContent:\\n', substr(content, 1, 2000),
        {_sql_text(fv.ARTICLE_PROMPT_LENGTH_NOTE)}, E'\\n\\nSummary:') as article_prompt
    from articles""",
    "articles",
)
def short_prompts(t):
    title, content = F.col("title"), F.col("content")
    return t.articles.select(
        "id", text.short_prompt(title, content, "Be brief.").alias("short_prompt"),
        text.article_prompt(title, content).alias("article_prompt"),
    )


@query(
    "snippets", "X18",
    "select id, concat('**', title, E'**\\n', content, E'\\n[Read more](', url, E')\\n') as snippet from articles", "articles",
)
def snippets(t):
    return t.articles.select("id", text.snippet(F.col("title"), F.col("content"), F.col("url")).alias("snippet"))


@query(
    "word_counts", "X23",
    r"""select doc_id, cast(len(regexp_extract_all(text, '\S+')) as int) as words, cast(length(text) as int) as chars from documents""",
)
def word_counts(t):
    return t.documents.select("doc_id", text.word_count(F.col("text")).alias("words"), F.length("text").alias("chars"))


@query(
    "parsed_responses", "X17",
    """select doc_id, case lang when 'en' then text when 'fr' then concat('fenced ', source)
        when 'de' then trim(text, E' \\t\\n\\r') else concat('{"key_points": ["', source, '"]}') end as summary,
      case lang when 'en' then concat(lang, '|', source) when 'fr' then '' when 'de' then '' else source end as key_points
    from documents""",
)
def parsed_responses(t):
    """Answers by language: JSON, fenced JSON without key points, plain text, JSON without a summary."""
    lang = F.col("lang")
    answer = (
        F.when(lang == "en", F.to_json(F.struct(F.col("text").alias("summary"), F.array("lang", "source").alias("key_points"))))
        .when(lang == "fr", F.concat(F.lit('```json\n{"summary": "fenced '), "source", F.lit('"}\n```')))
        .when(lang == "de", F.concat(F.lit(" "), F.translate("text", "{", "("), F.lit("\n")))
        .otherwise(F.concat(F.lit('{"key_points": ["'), "source", F.lit('"]}')))
    )
    parsed = t.documents.select("doc_id", responses.parse_response(answer).alias("p"))
    return parsed.select("doc_id", F.col("p.summary").alias("summary"), F.array_join("p.key_points", "|").alias("key_points"))


@query(
    "score_articles", "F1 F2 P10 X14 X17",
    f"""select id as article_id, 'longest-sentences' as model, coalesce({_longest_sql('content')}, '') as summary
    from (select id, coalesce(nullif(full_content, ''), content) as content from articles) a
    where length(content) >= 50""",
    "articles",
)
def score_articles(t):
    accepted = gates.summary_gate(t.articles).filter("accepted")
    prompt = text.summary_prompt(F.col("title"), F.col("gate_text"), limit=None)
    scored = scoring.score(accepted, prompt, content=F.col("gate_text"))
    return scored.select("article_id", "model", "summary")


@query(
    "embed_articles", "F3 F4 P11 P12",
    """select id as article_id, 'hashed-terms' as model, 384 as dimension, 1.0::double as length
       from (select a.id, coalesce(m.summary, nullif(a.full_content, ''), a.content) as body from articles a
         left join (select article_id, arg_min(summary, id) as summary from article_summaries group by 1) m on m.article_id = a.id) b
       where length(body) >= 10""",
    "articles article_summaries",
)
def embed_articles(t):
    from feedmill.functions.vectors import norm
    from feedmill.operators.joins import one_summary

    accepted = gates.embedding_gate(t.articles, one_summary(t.article_summaries)).filter("accepted")
    vectors = scoring.embed(accepted, "gate_text")
    return vectors.select(
        "article_id", "model", F.size("embedding").alias("dimension"), F.round(norm(F.col("embedding")), 5).alias("length")
    )


class _Refusing:
    """A scorer that refuses the first ``n`` calls of a prompt ending in ``|n``."""

    def __init__(self):
        self.refused = {}

    def __call__(self, prompt):
        already = self.refused.pop(prompt, 0)
        if already < int(prompt.rsplit("|", 1)[1]):
            self.refused[prompt] = already + 1
            raise ConnectionError(f"call {already + 1}")
        return f"answer to {prompt}"


@query(
    "retried_calls", "F5 F2",
    """select id as article_id, least(id % 5 + 1, 3)::int as attempts, case when id % 5 < 3 then concat('answer to ', title, '|', id % 5) end as summary,
      case when id % 5 >= 3 then 'ConnectionError: call 3' end as error from articles""",
    "articles",
)
def retried_calls(t):
    """Calls that succeed at the first, second or third attempt, or end in a row with the error."""
    prompt = F.concat("title", F.lit("|"), (F.col("id") % 5).cast("string"))
    scored = scoring.score(t.articles, prompt, _Refusing(), "refusing", wait=(0.0, 0.0))
    return scored.select("article_id", "attempts", "summary", "error")


VOWELS = "aeiou"


def _vowel_vectors(texts):
    """Counts of the five vowels of each text, of unit length."""
    counts = [[text.count(v) for v in VOWELS] for text in texts]
    return [[c / max(1.0, sum(x * x for x in row) ** 0.5) for c in row] for row in counts]


_VOWEL_COUNTS = ", ".join(f"length(content) - length(replace(content, '{v}', '')) as {v}" for v in VOWELS)
_VOWEL_SHARES = ", ".join(f"cast(cast({v} / greatest(1.0, sqrt(({' + '.join(f'{w} * {w}' for w in VOWELS)})::double)) as float) as double) as {v}" for v in VOWELS)


@query(
    "encoded_articles", "F3 F4 P12",
    f"""select id as article_id, 'vowels' as model, {_VOWEL_SHARES} from (select id, {_VOWEL_COUNTS} from articles where trim(content) <> '') c""",
    "articles",
)
def encoded_articles(t):
    """Vectors of a given encoder over whole texts, entry by entry."""
    vectors = scoring.embed(t.articles, "content", _vowel_vectors, "vowels").filter("embedding IS NOT NULL")
    return vectors.select("article_id", "model", *[F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate(VOWELS)])


@query(
    "search_requests", "P19",
    """select doc_id, doc_id % 3 = 1 and doc_id % 60 between 1 and 50 as accepted from documents""",
)
def search_requests(t):
    """Requests with one, two or no characters and limits from 0 to 59."""
    asked = F.when(F.col("doc_id") % 3 == 0, F.substring("lang", 1, 1)).when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return t.documents.select("doc_id", accepted_arguments(asked, F.col("doc_id") % 60).alias("accepted"))
