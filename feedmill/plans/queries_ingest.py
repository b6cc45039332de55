"""Feed scans, ingest, first-wins insert and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.functions.urls import canonical_url
from feedmill.operators import aggregates, dedup
from feedmill.operators.gates import declared_route, extraction_route, quality_rejects
from feedmill.operators.scoring import stage_rows
from feedmill.operators.state import article_state
from feedmill.plans import ingest
from feedmill.plans.catalog import query
from feedmill.plans.queries_serve import STATE_SQL
from feedmill.plans.views import AS_OF
from feedmill.session import scratch_path
from feedmill.sources import feeds, pages, tables

# What the landed feed documents hold, said directly over the articles.
_ENTRIES = """
select s.url as feed_url, a.id as feed_seq, 0 as entry_seq, s.id as source_id, s.source_type, s.active, a.category,
  case when a.category = 'es' then 'No Title' else a.title end as title, a.url,
  case when a.category <> 'de' then a.published_at end as published_at,
  case when a.category <> 'de' or s.source_type = 'youtube' then a.published_at end as dated_at,
  a.content as summary, a.video_id
from articles a join sources s on s.id = a.source_id where length(a.content) >= 50"""


@query(
    "feed_entries", "S1 X11",
    f"select feed_url, feed_seq, entry_seq, title, url, published_at, summary from ({_ENTRIES}) e", "articles sources",
)
def feed_entries(t):
    return feeds.feed_entries(t.landed_feeds).drop("video_id")


@query(
    "feed_entries_updated", "S3",
    f"select feed_seq, title, dated_at as published_at from ({_ENTRIES}) e", "articles sources",
)
def feed_entries_updated(t):
    return feeds.feed_entries(t.landed_feeds, use_updated=True).select("feed_seq", "title", "published_at")


@query(
    "unreadable_feeds", "S1",
    "select s.url as feed_url from articles a join sources s on s.id = a.source_id where length(a.content) < 50",
    "articles sources",
)
def unreadable_feeds(t):
    return feeds.unreadable_feeds(t.landed_feeds)


def _categories(t):
    return t.sources.filter(F.col("source_type") == "anthropic").select(
        F.col("url").alias("feed_url"), F.lit("research").alias("category")
    )


@query(
    "tagged_entries", "S2",
    f"select feed_url, 'research' as category, title, url, published_at from ({_ENTRIES}) e where source_type = 'anthropic'",
    "articles sources",
)
def tagged_entries(t):
    return feeds.tagged_entries(t.landed_feeds, _categories(t)).select(
        "feed_url", "category", "title", "url", "published_at"
    )


@query(
    "channel_entries", "S4 X1 X3 X4",
    f"select feed_url, title, url, video_id, published_at, summary from ({_ENTRIES}) e where source_type = 'youtube'",
    "articles sources",
)
def channel_entries(t):
    channels = feeds.channel_feeds(t.sources.filter(F.col("source_type") == "youtube")).select("feed_url")
    entries = feeds.channel_entries(t.landed_feeds.join(channels, "feed_url"))
    return entries.select("feed_url", "title", "url", "video_id", "published_at", "summary")


@query(
    "blog_routes", "S5",
    """select id, url, case when url like '%.xml' or url like '%.rss' or url like '%/feed' or url like '%/rss'
         then 'feed' else 'page' end as route from sources""",
    "sources",
)
def blog_routes(t):
    return feeds.blog_routes(t.sources).select("id", "url", "route")


# Main text of a page whose content sits in its article element, said in SQL.
# The semicolon of these entities may be missing where a text was cut.
def _decode(text: str) -> str:
    for name, char in (("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&#39", "''"), ("&copy", "©"),
                       ("&middot", "·"), ("&amp", "&")):
        text = f"regexp_replace({text}, '{name};?', '{char}', 'g')"
    return text


_SPLIT = r"""array_to_string(list_filter(list_transform(regexp_split_to_array({0}, '<[a-zA-Z/!][^>]*>|\n'),
  lambda x: trim({1}, E' \t\n\r')), lambda x: x <> ''), {2})"""
_ARTICLE = _SPLIT.format(r"regexp_extract(html, '(?s)<article>(.*)</article>', 1)", _decode("x"), r"E'\n'")
_PARAGRAPHS = (
    r"array_to_string(list_filter(list_transform(string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:], "
    r"lambda p: " + _SPLIT.format("regexp_replace(p, '(?s)</p>.*', '')", _decode("x"), "''") + r"), lambda p: p <> ''), E'\n\n')"
)
ARTICLE_TEXT = f"case when length({_ARTICLE}) > 100 then {_ARTICLE} else {_PARAGRAPHS} end"


@query(
    "blog_entries", "S6",
    f"select url, 'No Title' as title, case when text <> '' then text else concat('page ', page_id) end as content from (select url, page_id, {ARTICLE_TEXT} as text from pages) p",
)
def blog_entries(t):
    landed = t.pages.select(
        "page_id", "url",
        F.concat(
            F.lit("<rss><channel><item><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")),
            F.lit("</link><description>page "), F.col("page_id"), F.lit("</description></item></channel></rss>"),
        ).alias("xml"),
    ).select(F.concat(F.lit("https://feeds.example.org/"), "page_id").alias("feed_url"), "xml")
    texts = pages.read_page_features(t.landed_pages)
    return feeds.blog_entries(landed, texts).select("url", "title", "content")


_FOUND = f"""
select *, case when row_number() over (partition by url order by source_id, feed_seq, entry_seq) > 1
    or url in (select url from articles where category = 'de') then 'duplicate' else 'created' end as outcome
from ({_ENTRIES}) e where active and source_type in ('youtube', 'blog')
  and (source_type = 'youtube' or feed_url like '%/feed')
  and (source_type = 'blog' or published_at is null or published_at >= timestamp '2024-01-24 00:00:00')"""


def _labelled(t, source_id=None):
    store = t.articles.filter(F.col("category") == "de")
    return ingest.ingest(t.sources, t.landed_feeds, t.landed_pages, store, AS_OF, 168, source_id)


@query(
    "ingest_candidates", "S14 D1 S16 U1 W4",
    f"select source_id, title, url, summary as content, published_at, video_id, outcome from ({_FOUND}) f",
    "articles sources",
)
def ingest_candidates(t):
    return _labelled(t).drop("ingest_seq", "category")


@query(
    "ingest_new_articles", "S14 S10",
    f"select source_id, title, url, published_at, timestamp '{AS_OF}' as scraped_at, 'pending' as processing_status from ({_FOUND}) f where outcome = 'created'",
    "articles sources",
)
def ingest_new_articles(t):
    rows = ingest.new_articles(_labelled(t), AS_OF)
    return rows.select("source_id", "title", "url", "published_at", "scraped_at", "processing_status")


@query(
    "ingest_stats", "A4 S14",
    f"""select (select count(*) from sources where active and source_type in ('youtube', 'blog')) as sources_processed,
      count(*) as articles_found, count(*) filter (where outcome = 'created') as articles_new,
      count(*) filter (where outcome = 'duplicate') as articles_duplicate, cast(0 as bigint) as errors from ({_FOUND}) f""",
    "articles sources",
)
def ingest_stats(t):
    return ingest.stats(_labelled(t), t.sources)


@query(
    "ingest_one_source", "S15",
    f"select source_id, url, outcome from ({_FOUND}) f where source_id = 18", "articles sources",
)
def ingest_one_source(t):
    return _labelled(t, source_id=18).select("source_id", "url", "outcome")


@query(
    "origin_totals", "A5",
    f"""select coalesce(origin, 'all') as origin, count(*) as items, count(*) filter (where outcome = 'created') as created,
      count(*) filter (where outcome = 'duplicate') as duplicates, cast(0 as bigint) as errors
    from (select source_type as origin, outcome from ({_FOUND}) f) x group by rollup(origin)""",
    "articles sources",
)
def origin_totals(t):
    origins = t.sources.select(F.col("id").alias("source_id"), F.col("source_type").alias("origin"))
    return aggregates.origin_totals(_labelled(t).join(origins, "source_id"))


@query(
    "saved_entries", "S16 J7",
    f"""select source_id, title, url, summary as content, published_at, video_id, 'blog' as category, feed_seq as ingest_seq
    from ({_ENTRIES}) e where active""",
    "articles sources",
)
def saved_entries(t):
    entries = feeds.feed_entries(t.landed_feeds).withColumn("ingest_seq", F.col("feed_seq"))
    found = feeds.video_id(F.when(F.col("url").startswith("https://www.youtube.com/"), F.col("url")))
    return ingest.save_origin(entries, t.sources.filter("active"), F.col("summary"), F.lit("blog"), found)


@query(
    "unmatched_feeds", "J7",
    f"select feed_url, count(*) as skipped from ({_ENTRIES}) e where not active group by feed_url", "articles sources",
)
def unmatched_feeds(t):
    return ingest.unmatched_feeds(feeds.feed_entries(t.landed_feeds), t.sources.filter("active"))


@query(
    "category_resolution", "J7",
    f"""select url, title, case category when 'en' then c.id end as source_id,
      case when category not in ('en', 'fr') then 'unknown category' when category = 'fr' then 'no source' else 'ok' end as resolution
    from ({_ENTRIES}) e cross join (select id from sources where source_type = 'openai') c""",
    "articles sources",
)
def category_resolution(t):
    landed = feeds.feed_entries(t.landed_feeds).join(
        t.articles.select(F.col("id").alias("feed_seq"), "category"), "feed_seq"
    )
    official = t.sources.filter(F.col("source_type") == "openai").select(
        F.lit("en").alias("category"), F.col("url").alias("feed_url")
    )
    gone = official.select(F.lit("fr").alias("category"), F.lit("https://gone.example.org/feed").alias("feed_url"))
    resolved = ingest.resolve_category(landed, official.unionByName(gone), t.sources)
    return resolved.select("url", "title", "source_id", "resolution")


# --- first-wins insert and duplicates -----------------------------------------------------

_BATCH = """
select doc_id as ingest_seq, cast(substr(source, 4) as bigint) as source_id,
  case when length(text) >= 50 then concat('Doc ', doc_id) end as title, concat('https://t.example.com/', md5(text)) as url
from documents"""
_STORE = "select distinct concat('https://t.example.com/', md5(text)) as url from documents where lang = 'de'"
_INSERTED = f"""
select b.ingest_seq, b.source_id, b.title, b.url, case when title is null then 'error'
  when ingest_seq = min(case when title is not null then ingest_seq end) over (partition by b.url) and s.url is null
  then 'created' else 'duplicate' end as outcome
from ({_BATCH}) b left join ({_STORE}) s on s.url = b.url"""


def _batch(t):
    url = F.concat(F.lit("https://t.example.com/"), F.md5("text"))
    rows = t.documents.select(
        F.col("doc_id").alias("ingest_seq"), F.substring("source", 4, 10).cast("long").alias("source_id"),
        F.when(F.length("text") >= 50, F.concat(F.lit("Doc "), "doc_id")).alias("title"), url.alias("url"),
    )
    store = t.documents.filter(F.col("lang") == "de").select(url.alias("url")).distinct()
    return rows, store


@query("insert_labels", "D1 W4 J9", _INSERTED)
def insert_labels(t):
    return dedup.label_candidates(*_batch(t))


@query("insert_new_by_url", "D1 J9", f"select ingest_seq, source_id, title, url from ({_INSERTED}) i where outcome = 'created'")
def insert_new_by_url(t):
    return dedup.insert_new(*_batch(t))


@query(
    "insert_counts", "D1",
    f"""select count(*) filter (where outcome = 'created') as created, count(*) filter (where outcome = 'duplicate') as duplicates,
      count(*) filter (where outcome = 'error') as errors from ({_INSERTED}) i""",
)
def insert_counts(t):
    return dedup.outcome_counts(dedup.label_candidates(*_batch(t)))


@query(
    "canonical_urls", "D2",
    r"""select page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*[^?#]*'), '/+$', '') as canonical from pages""",
)
def canonical_urls(t):
    return t.pages.select("page_id", "url", canonical_url(F.col("url")).alias("canonical"))


@query(
    "canonical_inserts", "D2 D1",
    r"""select page_id as ingest_seq, c as canonical, case when row_number() over (partition by c order by page_id) = 1
         then 'created' else 'duplicate' end as outcome
       from (select page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*[^?#]*'), '/+$', '') as c from pages) p""",
)
def canonical_inserts(t):
    rows = t.pages.select(F.col("page_id").alias("ingest_seq"), canonical_url(F.col("url")).alias("canonical"))
    store = rows.filter(F.lit(False)).select("canonical")
    return dedup.label_candidates(rows, store, "canonical", required=("canonical",))


@query(
    "content_duplicates", "D3",
    """select sha256(text) as content_hash, min(doc_id) as first_doc_id, count(*) as copies from documents
       group by 1 having count(*) > 1""",
)
def content_duplicates(t):
    return dedup.copy_groups(t.documents).filter(F.col("copies") > 1)


@query(
    "copy_labels", "D3",
    "select doc_id, doc_id <> min(doc_id) over (partition by text) as is_duplicate from documents",
)
def copy_labels(t):
    return dedup.label_copies(t.documents)


@query(
    "quality_rejects", "P13 D3",
    """select doc_id, 'too_short' as rule from documents where length(text) < 100
       union all select doc_id, 'not_english' from documents where lang is distinct from 'en'
       union all select doc_id, 'duplicate' from (select doc_id, min(doc_id) over (partition by text) as f from documents) d where doc_id <> f""",
)
def quality_rejects_query(t):
    return quality_rejects(t.documents, dedup.first_copies(t.documents))


# --- extraction ---------------------------------------------------------------------------


@query(
    "extraction_routes", "P14",
    """select id, case when coalesce(video_id, '') <> '' then 'transcript' else 'page' end as method,
      case when category = 'en' then case when coalesce(video_id, '') <> '' then 'transcript' end
           when category = 'fr' then 'page' end as declared from articles""",
    "articles",
)
def extraction_routes(t):
    kind = F.when(F.col("category") == "en", F.lit("video")).when(F.col("category") == "fr", F.lit("article"))
    return t.articles.select(
        "id", extraction_route(F.col("video_id")).alias("method"), declared_route(kind, F.col("video_id")).alias("declared")
    )


@query(
    "extraction_outcomes", "F6 P9",
    """select id as article_id, 'extraction' as stage,
      case when coalesce(length(full_content) > 100, false) then 'skipped'
           when coalesce(content, '') = '' or length(content) < 50 then 'failed' else 'success' end as outcome,
      case when not coalesce(length(full_content) > 100, false) and (coalesce(content, '') = '' or length(content) < 50)
           then 'Content extraction failed' end as error_message
    from articles""",
    "articles",
)
def extraction_outcomes(t):
    from feedmill import fixed_values as fv
    from feedmill.operators.gates import extraction_gate

    found = F.when(F.length("content") >= 50, F.col("content"))
    gated = extraction_gate(t.articles).withColumnRenamed("id", "article_id")
    return stage_rows(
        gated, "extraction", F.col("already_extracted"), F.coalesce(found, F.lit("")) == "", F.lit(fv.EXTRACTION_FAILED)
    )


@query(
    "article_records", "S13",
    """select id, to_json({'id': id, 'title': title, 'url': url, 'video_id': video_id, 'content': content})::varchar as record from articles""",
    "articles",
)
def article_records(t):
    return t.articles.select("id", tables.as_json("id", "title", "url", "video_id", "content").alias("record"))


# --- configuration, sinks and dry runs ----------------------------------------------------

CHANNELS_PER_FILE = 1000


@query(
    "configured_channels", "S8",
    """select title as name, video_id as channel_id, nullif(category, 'de') as description from articles where coalesce(video_id, '') <> ''""",
    "articles",
)
def configured_channels(t):
    """Configuration files of a thousand entries each, most of them without a channel id, and one folder that is missing."""
    path = scratch_path(t.spark, "channels")
    blank = F.when(F.col("id") % 2 == 0, F.lit("")).alias("channel_id")
    entry = F.struct(F.col("title").alias("name"), F.coalesce("video_id", blank).alias("channel_id"), F.nullif("category", F.lit("de")).alias("description"))
    numbered = t.articles.select(F.expr(f"id div {CHANNELS_PER_FILE}").alias("file"), entry.alias("entry"))
    files = numbered.groupBy("file").agg(F.collect_list("entry").alias("channels"))
    files.write.partitionBy("file").json(path)
    return tables.read_channels(t.spark, path).unionByName(tables.read_channels(t.spark, f"{path}-missing"))


@query(
    "appended_features", "S11 D6",
    """select article_id, model, length(summary)::int as chars from article_summaries
       where model <> 'model-b' or article_id not in (select article_id from article_summaries where model = 'model-c')""",
    "article_summaries",
)
def appended_features(t):
    """One model's summaries, another model's twice, then what articles without any summary still lack."""
    path = scratch_path(t.spark, "features")
    features = t.article_summaries.select("article_id", "model", "summary")
    stored = lambda: t.spark.read.schema(features.schema).parquet(path)
    of = lambda model: features.filter(F.col("model") == model)
    tables.append_features(of("model-c"), features.limit(0), path)
    for _ in range(2):
        tables.append_features(of("model-a"), stored(), path, model="model-a")
    tables.append_features(of("model-b"), stored(), path)
    return stored().select("article_id", "model", F.length("summary").alias("chars"))


@query("state_of_log", "S12 T2", STATE_SQL, "processing_events")
def state_of_log(t):
    """Two appends to the event log; the state is derived from what the log holds."""
    path = scratch_path(t.spark, "log")
    for later in (False, True):
        tables.append_log(t.processing_events.filter((F.col("event_id") % 2 == 1) == F.lit(later)), path)
    return article_state(t.spark.read.schema(t.processing_events.schema).parquet(path))


@query(
    "dry_run", "S17",
    f"select outcome, count(*) as n, 0::bigint as stored from ({_FOUND}) f group by outcome", "articles sources",
)
def dry_run(t):
    """An ingest whose sink is not called: what it would do, and the rows its table holds afterwards."""
    path = scratch_path(t.spark, "articles")
    counts = _labelled(t).groupBy("outcome").agg(F.count("*").alias("n"))
    return counts.withColumn("stored", tables.read_articles(t.spark, path).agg(F.count("*").alias("n")).scalar())
