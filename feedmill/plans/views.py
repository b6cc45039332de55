"""The feature tables seen through the given test tables.

One SQL text per view serves both engines: Spark gets the given tables as DataFrames, the checks
inline the same text as common table expressions.  Only adding hours to a timestamp is spelled
differently.  Derived columns stand in for values the given tables lack; no view drops rows and
texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-01-31 00:00:00"
GIVEN: dict[str, str] = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
}

VIEWS: dict[str, str] = {
    "articles": """
        select doc_id as id, cast(substr(source, 4) as bigint) as source_id, concat('Doc ', doc_id) as title,
          case when source in ('src18', 'src19')
               then concat('https://www.youtube.com/watch?v=', substr(md5(cast(doc_id as string)), 1, 11))
               else concat('https://', source, '.example.com/a/', doc_id) end as url,
          text as content,
          case when doc_id % 11 = 0 then null else {hours:doc_id % 720} end as published_at,
          {hours:(doc_id * 7) % 720} as scraped_at,
          case when source in ('src18', 'src19') then substr(md5(cast(doc_id as string)), 1, 11) end as video_id,
          lang as category,
          case when doc_id % 5 = 0 then 'pending' when doc_id % 7 = 0 then 'failed' else 'completed' end
            as processing_status,
          case when lang <> 'fr' then text end as full_content,
          case when lang <> 'fr' then 'page' end as extraction_method
        from {documents}""",
    "sources": """
        select cast(substr(source, 4) as bigint) as id,
          case when source in ('src3', 'src4') then 'Shared' else source end as name,
          case when source in ('src18', 'src19') then 'youtube' when source = 'src16' then 'openai'
               when source = 'src17' then 'anthropic' else 'blog' end as source_type,
          case when source in ('src18', 'src19')
               then concat('https://www.youtube.com/feeds/videos.xml?channel_id=UC', substr(md5(source), 1, 22))
               when source in ('src1', 'src2') then concat('https://', source, '.example.com/blog')
               else concat('https://', source, '.example.com/feed') end as url,
          cast(substr(source, 4) as int) % 7 <> 0 as active
        from (select distinct source from {documents}) s""",
    "article_summaries": """
        select l.doc_id * 2 as id, l.doc_id as article_id,
          case when l.quality = 1 then 'model-a' else 'model-b' end as model, d.text as summary,
          case when l.toxic = 1 then null else array[d.lang, d.source] end as key_points
        from {labels} l join {documents} d on d.doc_id = l.doc_id
        union all
        select l.doc_id * 2 + 1, l.doc_id, 'model-c', concat(d.lang, ': ', d.text), array[d.source]
        from {labels} l join {documents} d on d.doc_id = l.doc_id
        where l.toxic = 1""",
    "article_embeddings": """
        select vec_id as id, vec_id as article_id, embedding, label,
          case when label < 5 then 'm1' else 'm2' end as model
        from {embeddings}""",
    "processing_events": """
        select event_id, ts, user_id as article_id,
          case event_type when 'error' then 'failed' when 'purchase' then 'completed' else 'pending' end as status,
          case event_type when 'signup' then 'extraction' when 'view' then 'summarization'
               when 'click' then 'embedding' when 'purchase' then 'completed' end as stage,
          case when event_type = 'error' then concat('code ', regexp_extract(props, '[0-9]+', 0)) end as error,
          case when event_type = 'error' then
            case cast(regexp_extract(props, '[0-9]+', 0) as int) % 4
              when 0 then 'extraction' when 1 then 'summarization' when 2 then 'embedding' end end as queue_name,
          case when event_type = 'error' then concat('model-', regexp_extract(props, '[0-9]+', 0)) end as model
        from {events}""",
    "pipeline_runs": """
        select min(event_id) as id, min(ts) as started_at, max(ts) as completed_at,
          count(case when event_type = 'purchase' then 1 end) as articles_processed,
          count(case when event_type = 'error' then 1 end) as articles_failed,
          count(case when event_type = 'view' then 1 end) as articles_skipped,
          'scheduled' as "trigger"
        from {events} group by cast(ts as date), hour(ts)""",
    "subscribers": """
        select c_custkey as id,
          case when c_nationkey = 3 then c_name
               else concat(lower(replace(c_name, '#', '.')), '@example.com') end as email,
          case when c_nationkey = 7 then null else c_name end as name,
          case c_mktsegment when 'BUILDING' then 'weekly' when 'MACHINERY' then 'custom' else 'daily' end as frequency,
          c_acctbal > 0 as is_active
        from {customer}""",
    "subscriber_filters": """
        select c_custkey as id,
          case c_custkey % 5 when 0 then null when 1 then '[]'
               when 2 then concat('[', c_nationkey % 20, ']')
               when 3 then concat('[', c_nationkey % 20, ', null, ', c_custkey % 20, ', ', c_nationkey % 20, ']')
               else concat('[', (c_custkey + 1) % 20, ', 99, ', c_custkey % 20, ']') end as filters
        from {customer}""",
    "subscription_log": """
        select o_custkey as id, o_orderkey as seq,
          case o_orderstatus when 'F' then 'unsubscribe' when 'O' then 'reactivate' else 'frequency' end as action,
          case when o_orderstatus = 'P' then
            case when o_orderpriority like '1%' then 'daily' when o_orderpriority like '2%' then 'weekly'
                 else 'custom' end end as frequency
        from {orders}""",
    "email_deliveries": """
        select o_orderkey as id, o_custkey as subscription_id,
          case o_orderstatus when 'F' then 'sent' when 'O' then 'pending' else 'failed' end as status,
          o_orderdate as sent_at
        from {orders}""",
    "transcript_segments": """
        select cast(conv_id as string) as video_id,
          case role when 'user' then 'en' when 'assistant' then 'de' else 'fr' end as language, turn as seq, text
        from {conversations}""",
}


def _hours(text: str, spelled) -> str:
    out = text
    while "{hours:" in out:
        start = out.index("{hours:")
        end = out.index("}", start)
        out = out[:start] + spelled(out[start + 7 : end]) + out[end + 1 :]
    return out


def _spark_hours(expression: str) -> str:
    return f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast({expression} as int))"


def _check_hours(expression: str) -> str:
    return f"timestamp '2024-01-01 00:00:00' + to_hours(cast({expression} as int))"


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given Parquet tables, with its explicit schema."""
    return spark.read.schema(GIVEN[table]).parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A feature table as a DataFrame over the given tables."""
    text = _hours(VIEWS[name], _spark_hours).replace('"trigger"', "`trigger`")
    text = text.replace("array[", "array(").replace("d.source]", "d.source)")
    tables = {t: given(spark, sf_dir, t) for t in GIVEN if f"{{{t}}}" in text}
    return spark.sql(text, **tables)


def check_sql(select: str, *names: str) -> str:
    """``select`` for the check engine with the named views as common table expressions."""
    parts = []
    for name in names:
        text = _hours(VIEWS[name], _check_hours)
        for table in GIVEN:
            text = text.replace(f"{{{table}}}", table)
        parts.append(f"{name} as ({text})")
    return f"with {', '.join(parts)}\n{select}" if parts else select


# --- landed documents ---------------------------------------------------------------------


def _xml(text):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def landed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed_url, feed_seq, xml): every article as a landed one-entry feed document of its source.

    Video sources land Atom, the others RSS.  Spanish entries lack a title, German ones a date
    (RSS) or only carry an update date (Atom); texts under 50 characters land as broken documents.
    """
    articles = view(spark, sf_dir, "articles")
    urls = view(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), F.col("url").alias("feed_url"))
    rows = articles.select("id", "source_id", "title", "url", "content", "category", "published_at").join(urls, "source_id")
    title = F.when(F.col("category") != "es", F.concat(F.lit("<title>"), _xml(F.col("title")), F.lit("</title>")))
    rfc = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss")
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rss_date = F.when(
        (F.col("category") != "de") & rfc.isNotNull(), F.concat(F.lit("<pubDate>"), rfc, F.lit(" GMT</pubDate>"))
    )
    atom_date = F.when(
        iso.isNotNull(),
        F.when(F.col("category") != "de", F.concat(F.lit("<published>"), iso, F.lit("</published>")))
        .otherwise(F.concat(F.lit("<updated>"), iso, F.lit("</updated>"))),
    )
    gap = F.lit("")
    rss = F.concat(
        F.lit('<rss version="2.0"><channel><title>feed</title><item>'), F.coalesce(title, gap),
        F.lit("<link>"), _xml(F.col("url")), F.lit("</link>"), F.coalesce(rss_date, gap),
        F.lit("<description>"), _xml(F.col("content")), F.lit("</description></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry>'), F.coalesce(title, gap),
        F.lit('<link rel="alternate" href="'), _xml(F.col("url")), F.lit('"/>'), F.coalesce(atom_date, gap),
        F.lit("<summary>"), _xml(F.col("content")), F.lit("</summary></entry></feed>"),
    )
    whole = F.when(F.col("feed_url").contains("channel_id="), atom).otherwise(rss)
    broken = F.concat(F.lit("<rss><channel><item>"), _xml(F.col("content")))
    return rows.select(
        "feed_url", F.col("id").alias("feed_seq"),
        F.when(F.length("content") < 50, broken).otherwise(whole).alias("xml"),
    )


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html) of the landed pages."""
    return given(spark, sf_dir, "pages").select("url", "html")
