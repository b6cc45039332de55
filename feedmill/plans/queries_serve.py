"""Filters, joins, rankings, digests, deliveries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill import fixed_values as fv
from feedmill.functions.urls import subscriber_link, valid_email
from feedmill.operators import aggregates, assembly, filters, joins, ranking
from feedmill.plans import daily, digests, reports, subscriptions
from feedmill.plans.catalog import query
from feedmill.plans.views import AS_OF
from feedmill.session import scratch_path

WEEK = 168
_CUT_WEEK = "timestamp '2024-01-24 00:00:00'"
_CUT_DAY = "timestamp '2024-01-30 00:00:00'"
_LONG = "'%B %d, %Y'"
_SHORT = "'%b %d, %Y'"


def _points(df):
    return df.withColumn("key_points", F.array_join("key_points", "|"))


_DIGEST = f"""
select a.id, a.title, a.url, a.published_at, strftime(a.published_at, {_LONG}) as published_date,
  s.name as source_name, m.model, m.summary, coalesce(array_to_string(m.key_points, '|'), '') as key_points
from articles a join article_summaries m on m.article_id = a.id join sources s on s.id = a.source_id
where a.published_at >= {_CUT_WEEK}"""


@query("digest_recent", "M1 P2 J1 K3 P17", _DIGEST, "articles article_summaries sources")
def digest_recent(t):
    return _points(digests.digest(t.articles, t.article_summaries, t.sources, AS_OF, WEEK))


@query("digest_of_source", "M3 J2 P17", _DIGEST + " and s.name = 'Shared'", "articles article_summaries sources")
def digest_of_source(t):
    return _points(digests.digest(t.articles, t.article_summaries, t.sources, AS_OF, WEEK, "Shared"))


_TOP = f"""
select * from (
  select a.id, s.name as source_name, a.title, a.url, a.content, a.published_at,
    cast(row_number() over (partition by s.name order by a.published_at desc nulls first, a.id) as int) as position
  from articles a join sources s on s.id = a.source_id where a.scraped_at >= {_CUT_WEEK}) r
where position <= 5"""


@query(
    "digest_top_per_source", "M2 P1 J3 W1",
    f"select id, source_name, title, url, published_at, position from ({_TOP}) x", "articles sources",
)
def digest_top_per_source(t):
    top = digests.top_articles(t.articles, t.sources, AS_OF, WEEK)
    return top.select("id", "source_name", "title", "url", "published_at", "position")


# The offline scorer in SQL: the three longest sentences of the whole content, in reading order.
_SENTENCES = r"list_transform(regexp_extract_all({text}, '[^.!?]+[.!?]*'), lambda x: trim(x, E' \t\n\r\f\v'))"


def _longest_sql(text: str) -> str:
    found = _SENTENCES.format(text=text)
    return f"""(select string_agg(sentence, ' ' order by i) from (
        select sentence, i from (
          select unnest({found}) as sentence, unnest(range(len({found}))) as i) u
        order by length(sentence) desc, i limit 3) w)"""


_SCORED = f"""
select * from (
  select id, source_name, title, url, published_at, position, {_longest_sql('body')} as summary
  from (select *, coalesce(nullif(content, ''), title) as body from ({_TOP}) x) y) z
where coalesce(summary, '') <> ''"""


@query("digest_scored", "M2 F1 X15", _SCORED, "articles sources")
def digest_scored(t):
    scored = digests.scored_digest(t.articles, t.sources, AS_OF, WEEK)
    return scored.select("id", "source_name", "title", "url", "published_at", "position", "summary")


_SECTION = f"""
select source_name, count(*) as n_items,
  concat(E'\\n📰 ', upper(source_name), E'\\n', repeat('-', 60), E'\\n',
    string_agg(concat(E'\\n• ', title, coalesce(E'\\n  ' || strftime(published_at, {_SHORT}), ''),
      E'\\n\\n  ', summary, E'\\n  Read more: ', url, E'\\n'), E'\\n' order by position)) as text_body,
  concat('<h2>📰 ', source_name, '</h2>',
    string_agg(concat('<div><h3><a href="', url, '">', title, '</a></h3>',
      coalesce('<small>' || strftime(published_at, {_SHORT}) || '</small>', ''),
      '<p>', summary, '</p><a href="', url, '">Read more →</a></div>'), '' order by position)) as html_body
from ({_SCORED}) d group by source_name"""


@query("digest_sections", "M2 A2 X19 X20", _SECTION, "articles sources")
def digest_sections(t):
    scored = digests.scored_digest(t.articles, t.sources, AS_OF, WEEK)
    return digests.section_bodies(digests.sections(scored))


_BODY_HEAD = "concat(repeat('=', 60), E'\\nDAILY NEWS DIGEST\\nJanuary 31, 2024\\n', repeat('=', 60), E'\\n\\n')"
_HTML_HEAD = "'<h1>🗞 Daily News Digest</h1><p>January 31, 2024</p><hr>'"
_BEFORE = "over (order by newest desc nulls first, first_id rows between unbounded preceding and 1 preceding)"


@query(
    "digest_body", "M2 A2 X19 X20",
    f"""select * from (with bodies as (
      select b.source_name, n_items, concat(text_body, E'\\n') as text_part, html_body as html_part, newest, first_id from ({_SECTION}) b
      join (select source_name, case when count(*) = count(published_at) then max(published_at) end as newest,
          arg_min(id, position) as first_id from ({_SCORED}) d group by source_name) o on o.source_name = b.source_name)
    select 'opening' as part, null as source_name, 0 as n_items, 0 as text_start, {_BODY_HEAD} as text_part, 0 as html_start, {_HTML_HEAD} as html_part
    union all select 'section', source_name, n_items,
      cast(length({_BODY_HEAD}) + coalesce(sum(length(text_part)) {_BEFORE}, 0) as bigint), text_part,
      cast(length({_HTML_HEAD}) + coalesce(sum(length(html_part)) {_BEFORE}, 0) as bigint), html_part from bodies
    union all select 'closing', null, 0, cast(length({_BODY_HEAD}) + coalesce(sum(length(text_part)), 0) as bigint),
      concat(E'\\n', repeat('=', 60), E'\\nGenerated by Daily News Digest\\n', repeat('=', 60)),
      cast(length({_HTML_HEAD}) + coalesce(sum(length(html_part)), 0) as bigint),
      '<hr><p>This digest was automatically generated by Daily News Digest</p>' from bodies) p""",
    "articles sources",
)
def digest_body(t):
    return digests.digest_body(digests.sections(digests.scored_digest(t.articles, t.sources, AS_OF, WEEK)), AS_OF)


@query(
    "digest_totals", "A14",
    f"select count(*) as total_articles, count(distinct source_name) as total_sources, count(*) > 0 as success from ({_TOP}) x",
    "articles sources",
)
def digest_totals(t):
    return digests.digest_totals(digests.top_articles(t.articles, t.sources, AS_OF, WEEK))


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"


def _e(text: str) -> str:
    return _ESC.format(text)


_PARTS = f"""
select id, model, published_at,
  concat(repeat('-', 80), E'\\n', title, E'\\n', url, E'\\n\\nSource: ', source_name, ' | Published: ', published_date,
    E'\\n\\n', summary,
    case when len(kp) > 0 then concat(E'\\n\\nKey Insights:\\n',
      array_to_string(list_transform(kp, lambda p: concat('  • ', p)), E'\\n')) else '' end, E'\\n') as text_part,
  concat('<div class="article"><h2><a href="', {_e('url')}, '">', {_e('title')}, '</a></h2><div>', {_e('source_name')},
    ' • ', {_e('published_date')}, '</div><p>', {_e('summary')}, '</p>',
    case when len(kp) > 0 then concat('<h3>Key Insights</h3><ul>',
      array_to_string(list_transform(kp, lambda p: concat('<li>', {_e('p')}, '</li>')), ''), '</ul>') else '' end,
    '</div>') as html_part
from (select a.id, a.title, a.url, a.published_at, strftime(a.published_at, {_LONG}) as published_date,
    s.name as source_name, m.model, m.summary, m.key_points as kp
  from articles a join article_summaries m on m.article_id = a.id join sources s on s.id = a.source_id
  where a.published_at >= {_CUT_WEEK}) d"""


@query("digest_parts", "X19 X20", _PARTS, "articles article_summaries sources")
def digest_parts(t):
    items = digests.digest(t.articles, t.article_summaries, t.sources, AS_OF, WEEK, ordered=False)
    return digests.digest_parts(items)


_BAR = "repeat('=', 80)"
_DELIVERIES = f"""
select u.id as subscription_id, u.email, coalesce(nullif(u.name, ''), 'Reader') as reader,
  'Daily News Digest - January 31, 2024' as subject,
  concat(E'DAILY NEWS DIGEST\\nJanuary 31, 2024\\n', {_BAR}, E'\\n\\n', cast(n as varchar),
    E' new articles from your news sources\\n\\n') as text_head,
  concat({_BAR}, E'\\n\\nYou''re receiving this because you subscribed to Daily News Digest\\n\\nUnsubscribe: ',
    'http://localhost:8000/unsubscribe?email=', u.email, E'\\nManage Preferences: ',
    'http://localhost:8000/preferences?email=', u.email, E'\\n') as text_tail,
  concat('<!DOCTYPE html><html><head><meta charset="UTF-8"><title>Daily News Digest</title></head><body><div class="container">',
    '<div class="header"><h1>Daily News Digest</h1><p>January 31, 2024</p></div><div class="content"><div class="summary"><p><strong>',
    cast(n as varchar), '</strong> new articles from your news sources</p></div>') as html_head,
  concat('</div><div class="footer"><p>You''re receiving this because you subscribed to Daily News Digest</p><p><a href="',
    {_e("concat('http://localhost:8000/unsubscribe?email=', u.email)")}, '">Unsubscribe</a> • <a href="',
    {_e("concat('http://localhost:8000/preferences?email=', u.email)")}, '">Manage Preferences</a></p></div></div></body></html>') as html_tail,
  n as articles_count,
  case when n > 0 and ok then 'sent' else 'failed' end as status,
  case when n = 0 then 'No articles found' when not ok then 'Invalid email address' end as error_message,
  timestamp '2024-01-31 00:00:00' as sent_at
from (select *, regexp_matches(email, '{fv.EMAIL_PATTERN}') as ok,
    (select count(*) from articles a join article_summaries m on m.article_id = a.id
       join sources s on s.id = a.source_id where a.published_at >= {_CUT_WEEK}) as n
  from subscribers where is_active) u"""


@query(
    "subscriber_deliveries", "M4 J11 P5 X21 X24", _DELIVERIES, "articles article_summaries sources subscribers"
)
def subscriber_deliveries(t):
    items = digests.digest(t.articles, t.article_summaries, t.sources, AS_OF, WEEK, ordered=False)
    return digests.deliveries(t.subscribers, items, AS_OF)


_SETS = """select id, coalesce(array_to_string(list_sort(list_distinct(list_filter(cast(json(filters) as bigint[]), lambda x: x is not null))), ','), '') as filter_set
  from subscriber_filters"""
_KEYS = f"""select a.id, a.source_id from articles a join article_summaries m on m.article_id = a.id
  join sources s on s.id = a.source_id where a.published_at >= {_CUT_WEEK}"""
_IN_SET = "filter_set = '' or list_contains(string_split(filter_set, ','), cast(source_id as varchar))"
_FILTERED = f"""
select u.id as subscription_id, f.filter_set, coalesce(c.n, 0) as articles_count,
  case when coalesce(c.n, 0) > 0 and regexp_matches(u.email, '{fv.EMAIL_PATTERN}') then 'sent' else 'failed' end as status,
  case when coalesce(c.n, 0) = 0 then 'No articles found' when not regexp_matches(u.email, '{fv.EMAIL_PATTERN}') then 'Invalid email address' end as error_message,
  concat(E'DAILY NEWS DIGEST\\nJanuary 31, 2024\\n', {_BAR}, E'\\n\\n', cast(coalesce(c.n, 0) as varchar),
    E' new articles from your news sources\\n\\n') as text_head, coalesce(c.ids, '') as articles_ids, timestamp '{AS_OF}' as created_at
from subscribers u join ({_SETS}) f on f.id = u.id left join (
  select filter_set, count(*) as n, array_to_string(list_sort(list(distinct k.id)), ',') as ids
  from (select distinct filter_set from ({_SETS}) x) s join ({_KEYS}) k on {_IN_SET} group by filter_set) c on c.filter_set = f.filter_set
where u.is_active"""


def _with_filters(t):
    filters = t.subscriber_filters.select("id", F.from_json("filters", "array<bigint>").alias("source_filters"))
    return t.subscribers.join(filters, "id")


@query(
    "filtered_deliveries", "J11 M4", _FILTERED, "articles article_summaries sources subscribers subscriber_filters"
)
def filtered_deliveries(t):
    """Deliveries by source filter with their log: null, empty, repeated, unknown and overlapping filters."""
    keys = subscriptions.digest_keys(t.articles, t.article_summaries, t.sources, AS_OF, WEEK)
    subscribers = _with_filters(t)
    rows = subscriptions.filtered_deliveries(subscribers, keys, AS_OF)
    articles = subscriptions.set_articles(subscriptions.filter_index(subscribers), keys)
    as_text = lambda ids: F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
    log = subscriptions.delivery_log(rows, articles, as_text, extra=["filter_set", "text_head"])
    return log.select(
        "subscription_id", "filter_set", "articles_count", "status", "error_message", "text_head", "articles_ids", "created_at"
    )


@query(
    "subscriber_addresses", "P15 X21 X22",
    f"""select id, email, regexp_matches(email, '{fv.EMAIL_PATTERN}') as valid,
      concat('http://localhost:8000/unsubscribe?email=', email) as unsubscribe_url,
      concat(upper(substr(split_part(email, '@', 1), 1, 1)), lower(substr(split_part(email, '@', 1), 2))) as name
    from subscribers""",
    "subscribers",
)
def subscriber_addresses(t):
    named = digests.ad_hoc_reader(t.subscribers).select("name", "email")
    subscribers = t.subscribers.select(
        "id", "email", valid_email(F.col("email")).alias("valid"),
        subscriber_link(F.col("email"), "unsubscribe", digests.BASE_URL).alias("unsubscribe_url"),
    )
    return subscribers.join(named, "email")


@query(
    "source_prompts", "X16 W3 X13",
    f"""select source_name, count(*) as n_items,
      concat(E'\\n## ', source_name, E'\\n\\n', string_agg(concat(cast(position as varchar), '. **', title,
        E'**\\n   URL: ', url, E'\\n   Content preview: ', substr(content, 1, 300), E'...\\n'), E'\\n' order by position))
        as prompt_section
    from ({_TOP}) x group by source_name""",
    "articles sources",
)
def source_prompts(t):
    return digests.source_prompts(digests.top_articles(t.articles, t.sources, AS_OF, WEEK))


_PROMPT_HEAD = f"concat('{fv.DIGEST_PROMPT_HEAD.replace(chr(39), chr(39) * 2)}', E'\\n\\n')"
_PROMPT_TAIL = f"'{fv.DIGEST_PROMPT_TAIL}'"


@query(
    "digest_prompt", "X16 W3 X13",
    f"""select * from (with sections as (
      select source_name, count(*) as n_items, concat(E'\\n## ', source_name, E'\\n\\n', string_agg(concat(cast(position as varchar),
          '. **', title, E'**\\n   URL: ', url, E'\\n   Content preview: ', substr(content, 1, 300), E'...\\n'), E'\\n'
          order by position), E'\\n') as text,
        arg_min(id, position) as first_id, max(case when position = 1 then published_at end) as first_at
      from ({_TOP}) x group by source_name)
    select 'opening' as part, null as source_name, 0 as n_items, 0 as start, {_PROMPT_HEAD} as text
    union all select 'section', source_name, n_items, cast(length({_PROMPT_HEAD}) + coalesce(sum(length(text)) over
        (order by first_at desc nulls first, first_id rows between unbounded preceding and 1 preceding), 0) as bigint), text from sections
    union all select 'closing', null, 0, cast(length({_PROMPT_HEAD}) + coalesce(sum(length(text)), 0) as bigint),
        concat(case when count(*) > 0 then E'\\n' else E'\\n\\n' end, {_PROMPT_TAIL}) from sections) p""",
    "articles sources",
)
def digest_prompt(t):
    return digests.digest_prompt(digests.top_articles(t.articles, t.sources, AS_OF, WEEK))


# --- filters ------------------------------------------------------------------------------


@query(
    "recent_articles", "P1 K1",
    f"select id, url, scraped_at from articles where scraped_at >= {_CUT_WEEK} order by scraped_at desc, id limit 100",
    "articles",
)
def recent_articles(t):
    return ranking.recent_articles(t.articles.select("id", "url", "scraped_at"), AS_OF, WEEK)


@query(
    "articles_of_source", "P4 K2",
    """select id, title, published_at from articles where source_id = 9
       order by published_at desc nulls first, id limit 100""",
    "articles",
)
def articles_of_source(t):
    return ranking.articles_of_source(t.articles, 9).select("id", "title", "published_at")


@query(
    "any_recent", "K6 P2",
    f"select id, published_at from articles where published_at >= {_CUT_WEEK} order by id limit 100", "articles",
)
def any_recent(t):
    return ranking.any_recent(t.articles.select("id", "published_at"), AS_OF, WEEK, 100)


@query(
    "articles_with_summaries", "J12",
    """select a.id, a.title, m.model, m.summary from articles a join article_summaries m on m.article_id = a.id
       order by a.id, m.model limit 50""",
    "articles article_summaries",
)
def articles_with_summaries(t):
    return ranking.first_with_summaries(t.articles, t.article_summaries, 50)


@query(
    "undated_kept", "P3",
    f"select id, published_at from articles where published_at is null or published_at >= {_CUT_WEEK}", "articles",
)
def undated_kept(t):
    return filters.published_within(t.articles.select("id", "published_at"), AS_OF, WEEK, keep_undated=True)


@query("articles_by_url", "P4", "select a.id, a.url from articles a where a.url in (select concat('https://', source, '.example.com/a/', doc_id) from documents where lang = 'es')", "articles")
def articles_by_url(t):
    keys = t.documents.filter(F.col("lang") == "es").select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), F.col("doc_id")).alias("url")
    )
    return filters.lookup(t.articles.select("id", "url"), "url", keys)


@query("sources_of_type", "P5", "select id, name, url from sources where source_type = 'blog' and active", "sources")
def sources_of_type(t):
    return filters.sources_of_type(t.sources, "blog").select("id", "name", "url")


@query(
    "source_list", "M10 P5 S9",
    "select id, name, source_type, url, case when active then 'Active' else 'Inactive' end as status from sources",
    "sources",
)
def source_list(t):
    return reports.source_list(t.sources)


@query(
    "work_queue", "P6",
    f"""select id, processing_status, scraped_at from articles
        where scraped_at >= {_CUT_WEEK} and processing_status in ('pending', 'failed')""",
    "articles",
)
def work_queue(t):
    return filters.needing_work(t.articles.select("id", "processing_status", "scraped_at"), AS_OF, WEEK)


# --- joins and reports --------------------------------------------------------------------

STATE_SQL = """
select article_id, arg_max(status, seq) as status,
  arg_max(stage, seq) filter (where stage is not null) as current_stage,
  count(*) filter (where error is not null) as retry_count,
  arg_max(error, seq) filter (where error is not null) as error_message, max(ts) as updated_at
from (select *, row_number() over (order by ts, event_id) as seq from processing_events) e group by article_id"""


@query(
    "lineage_24h", "M6 J5 P18 P1",
    f"""select a.id, a.title, q.status, q.retry_count, m.summary is not null as has_summary,
      e.embedding is not null as has_embedding
    from articles a left join ({STATE_SQL}) q on q.article_id = a.id
      left join article_summaries m on m.article_id = a.id left join article_embeddings e on e.article_id = a.id
    where a.scraped_at >= {_CUT_DAY}""",
    "articles article_summaries article_embeddings processing_events",
)
def lineage_24h(t):
    from feedmill.operators.state import article_state

    return reports.lineage_report(
        t.articles, article_state(t.processing_events), t.article_summaries, t.article_embeddings, AS_OF, 24
    )


@query(
    "fully_processed", "J6",
    """select count(*) as join_rows, count(distinct a.id) as articles from articles a
      join article_summaries m on m.article_id = a.id join article_embeddings e on e.article_id = a.id""",
    "articles article_summaries article_embeddings",
)
def fully_processed(t):
    return joins.fully_processed(t.articles, t.article_summaries, t.article_embeddings)


@query(
    "one_summary", "W6",
    """select id, article_id, model, summary from (select *, row_number() over (partition by article_id order by id) as r
       from article_summaries) x where r = 1""",
    "article_summaries",
)
def one_summary(t):
    return joins.one_summary(t.article_summaries).select("id", "article_id", "model", "summary")


@query(
    "category_samples", "W2 A3",
    """select * from (select a.category, a.id, a.title, cast(row_number() over (partition by a.category
         order by a.published_at desc nulls first, a.id) as int) as position from articles a) r where position <= 3""",
    "articles",
)
def category_samples(t):
    top = ranking.top_per_group(
        t.articles.select("id", "category", "title", "published_at"), "category", 3, ranking.newest_first()
    )
    return top.select("category", "id", "title", "position")


@query("category_counts", "A3", "select category, count(*) as n from articles group by category", "articles")
def category_counts(t):
    return aggregates.count_by(t.articles, "category")


@query(
    "sources_per_type", "A15",
    """select v.source_type, count(s.id) as n from (values ('youtube'), ('openai'), ('anthropic'), ('blog')) v(source_type)
       left join sources s on s.source_type = v.source_type group by v.source_type""",
    "sources",
)
def sources_per_type(t):
    return aggregates.count_allowed(t.sources, "source_type", fv.SOURCE_TYPES)


_COUNTS = " union all ".join(
    f"select '{n}' as table_name, count(*) as n_rows from {v}"
    for n, v in (
        ("sources", "sources"), ("articles", "articles"), ("summaries", "article_summaries"),
        ("embeddings", "article_embeddings"), ("subscriptions", "subscribers"),
    )
)


def _count_tables(t):
    return {
        "sources": t.sources, "articles": t.articles, "summaries": t.article_summaries,
        "embeddings": t.article_embeddings, "subscriptions": t.subscribers,
    }


@query("table_counts", "A6", _COUNTS, "sources articles article_summaries article_embeddings subscribers")
def table_counts(t):
    return aggregates.table_counts(_count_tables(t))


@query(
    "health_rollup", "A9",
    f"""select case when bool_and(ok) then 'healthy' when bool_or(ok) then 'degraded' else 'unhealthy' end as status,
      count(*) as checks, count(*) filter (where ok) as passed
    from (select n_rows > 0 as ok from ({_COUNTS}) c
      union all select not exists (select 1 from articles a where a.full_content is null)) x""",
    "sources articles article_summaries article_embeddings subscribers",
)
def health_rollup(t):
    filled = aggregates.table_counts(_count_tables(t)).select((F.col("n_rows") > 0).alias("ok"))
    extracted = t.articles.agg((F.count_if(F.col("full_content").isNull()) == 0).alias("ok"))
    return aggregates.health_rollup(filled.unionByName(extracted))


@query(
    "feature_completeness", "A16",
    """select count(*) as articles,
      round(100.0 * count(*) filter (where id in (select article_id from article_summaries)) / count(*), 6) as pct_with_summary,
      round(100.0 * count(*) filter (where id in (select article_id from article_embeddings)) / count(*), 6) as pct_with_embedding
    from articles""",
    "articles article_summaries article_embeddings",
)
def feature_completeness(t):
    return aggregates.completeness(t.articles, t.article_summaries, t.article_embeddings)


@query(
    "delivery_summary", "A8",
    """select cast(sent_at as date) as day, count(*) as total, count(*) filter (where status = 'sent') as sent,
      count(*) filter (where status = 'failed') as failed from email_deliveries group by 1""",
    "email_deliveries",
)
def delivery_summary(t):
    return aggregates.delivery_summary(t.email_deliveries.withColumn("day", F.to_date("sent_at")), "day")


@query(
    "delivery_totals", "A8",
    """select count(*) as total, count(*) filter (where status = 'sent') as sent,
      count(*) filter (where status = 'failed') as failed from email_deliveries""",
    "email_deliveries",
)
def delivery_totals(t):
    return aggregates.delivery_summary(t.email_deliveries)


@query(
    "run_history", "M7 K5",
    """select started_at, completed_at, articles_processed, articles_failed, articles_skipped, "trigger"
       from pipeline_runs order by started_at desc, id desc limit 10""",
    "pipeline_runs",
)
def run_history(t):
    return ranking.latest_runs(t.pipeline_runs).drop("id")


@query(
    "run_trend", "A17",
    """select cast(started_at as date) as day, count(*) as runs, cast(sum(articles_processed) as bigint) as processed,
      cast(sum(articles_failed) as bigint) as failed, cast(sum(articles_skipped) as bigint) as skipped
    from pipeline_runs group by 1""",
    "pipeline_runs",
)
def run_trend(t):
    return aggregates.run_trend(t.pipeline_runs)


# --- transcripts --------------------------------------------------------------------------


@query(
    "transcripts", "A12",
    """select video_id, seq // 1000 as part, count(*) as n_segments, string_agg(text, ' ' order by seq) as content
       from transcript_segments group by video_id, seq // 1000""",
    "transcript_segments",
)
def transcripts(t):
    return assembly.assemble(t.transcript_segments, ["video_id"])


@query(
    "transcript_language", "A13 A12",
    """select s.video_id, s.language, seq // 1000 as part, count(*) as n_segments, string_agg(text, ' ' order by seq) as content
       from transcript_segments s join (
         select video_id, arg_min(language, (case when language in ('en', 'en-US', 'en-GB') then '0' else '1' end) || language) as language
         from transcript_segments group by video_id) c on c.video_id = s.video_id and c.language = s.language
       group by s.video_id, s.language, seq // 1000""",
    "transcript_segments",
)
def transcript_language(t):
    chosen = assembly.choose_language(t.transcript_segments)
    return assembly.assemble(chosen, ["video_id", "language"])


@query(
    "transcript_presence", "A10 J4",
    """select count(s.video_id) as with_value, count(*) - count(s.video_id) as without_value
       from articles a left join (select distinct video_id from transcript_segments) s on s.video_id = cast(a.id as varchar)""",
    "articles transcript_segments",
)
def transcript_presence(t):
    videos = t.transcript_segments.select("video_id").distinct()
    rows = t.articles.select(F.col("id").cast("string").alias("key"))
    joined = rows.join(videos, rows["key"] == videos["video_id"], "left")
    return aggregates.presence_split(joined, F.col("video_id"))


# --- the daily run ------------------------------------------------------------------------


class _Stopping(daily.Ledger):
    """A ledger that stops the run once before it notes each step."""

    def __init__(self, spark, store):
        super().__init__(spark, store)
        self.stopped = set()

    def enter(self, run, step, content=None):
        if step not in self.stopped:
            self.stopped.add(step)
            raise InterruptedError(step)
        super().enter(run, step, content)


@query(
    "daily_run_resumed", "T8 S12 M4 A11",
    f"""select id as subscription_id, 1::bigint as deliveries, 1::bigint as runs,
      case when regexp_matches(email, '{fv.EMAIL_PATTERN}') then 'sent' else 'failed' end as status, true as same_articles
    from subscribers where is_active""",
    "subscribers",
)
def daily_run_resumed(t):
    """A run over all landed feeds that stops before it notes each of its steps, and is called until it ends: one digest."""
    store = daily.Store(scratch_path(t.spark, "daily"))
    ledger = _Stopping(t.spark, store)
    for _ in range(len(daily.STEPS) + 2):
        try:
            daily.daily_run(t.spark, store, t.sources, t.landed_feeds, t.landed_pages, t.subscribers, AS_OF, WEEK, ledger=ledger)
            break
        except InterruptedError:
            pass
    sent = t.spark.read.parquet(store.path("email_deliveries"))
    audit = t.spark.read.parquet(store.path("pipeline_runs")).agg(F.count("*").alias("n")).scalar()
    stored = t.spark.read.parquet(store.path("articles")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))
    whole = stored.select((F.col("n") == F.col("urls")).alias("w")).scalar()
    return sent.groupBy("subscription_id", "status").agg(
        F.count("*").alias("deliveries"), F.bool_and((F.size("articles_ids") == F.col("articles_count")) & whole).alias("same_articles")
    ).withColumn("runs", audit)
