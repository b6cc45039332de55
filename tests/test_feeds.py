import datetime
import json

import pytest
from pyspark.sql import functions as F

from feedmill import schemas
from feedmill.plans import ingest
from feedmill.sources import feeds, tables

RSS = """<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title>
<item><title>One &amp; only</title><link>https://e.com/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><description>&lt;b&gt;s&lt;/b&gt;</description></item>
<item><guid isPermaLink="false">g</guid></item>
<item><title>Updated</title><link>https://e.com/3</link><updated>2024-01-05T00:00:00Z</updated></item>
</channel></rss>"""
ATOM = """<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="y" xmlns:media="m"><title>t</title>
<entry><id>x</id><yt:videoId>dQw4w9WgXcQ</yt:videoId><title>Vid</title><link rel="self" href="https://s"/><link rel="alternate" href="https://www.youtube.com/watch?v=dQw4w9WgXcQ"/>
<published>2024-01-02T03:04:05+00:00</published><updated>2024-01-03T00:00:00+00:00</updated><media:group><media:description>words</media:description></media:group></entry></feed>"""


@pytest.fixture(scope="module")
def landed(spark):
    return spark.createDataFrame(
        [("rss", RSS), ("https://www.youtube.com/feeds/videos.xml?channel_id=UC1", ATOM), ("bad", "<rss><channel><item>"), ("empty", ""), ("null", None),
         ("none", "<rss><channel><title>t</title></channel></rss>")],
        "feed_url string, xml string",
    )


def test_entries_and_defaults(landed):
    got = {(r.feed_url[:3], r.entry_seq): r for r in feeds.feed_entries(landed).collect()}
    assert set(got) == {("rss", 0), ("rss", 1), ("rss", 2), ("htt", 0)}
    first, bare, video = got["rss", 0], got["rss", 1], got["htt", 0]
    assert (first.title, first.url, first.summary) == ("One & only", "https://e.com/1", "<b>s</b>")
    assert first.published_at == datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert (bare.title, bare.url, bare.summary, bare.published_at) == ("No Title", "", "", None)
    assert (video.url, video.summary, video.video_id) == ("https://www.youtube.com/watch?v=dQw4w9WgXcQ", "words", "dQw4w9WgXcQ")
    assert got["rss", 2].published_at is None


def test_update_date_stands_in_only_when_asked(landed):
    got = {r.title: r.published_at for r in feeds.feed_entries(landed, use_updated=True).collect()}
    assert got["Updated"] == datetime.datetime(2024, 1, 5)
    assert got["Vid"] == datetime.datetime(2024, 1, 2, 3, 4, 5)


def test_unreadable_feeds_are_reported(landed):
    assert {r.feed_url for r in feeds.unreadable_feeds(landed).collect()} == {"bad", "empty", "null"}


def test_recent_entries_keep_undated(landed):
    kept = feeds.recent_entries(feeds.feed_entries(landed), "2024-01-03", 24)
    assert {r.title for r in kept.collect()} == {"One & only", "No Title", "Updated", "Vid"}
    assert {r.title for r in feeds.recent_entries(feeds.feed_entries(landed), "2024-01-10", 24).collect()} == {"No Title", "Updated"}
    assert feeds.recent_entries(feeds.feed_entries(landed), "2030-01-01", None).count() == 4


def test_tagging_and_transcripts(spark, landed):
    tags = spark.createDataFrame([("rss", "news"), ("bad", "research"), ("missing", "engineering")], "feed_url string, category string")
    assert [r.category for r in feeds.tagged_entries(landed, tags).collect()] == ["news"] * 3
    transcripts = spark.createDataFrame([("dQw4w9WgXcQ", "spoken")], "video_id string, content string")
    video = feeds.channel_entries(landed.filter("feed_url like 'https%'"), transcripts).first()
    assert (video.video_id, video.transcript) == ("dQw4w9WgXcQ", "spoken")
    bronze = feeds.to_bronze(feeds.channel_entries(landed))
    assert bronze.columns == schemas.FEED_ENTRIES.names


def test_handles_are_resolved_by_their_page(spark):
    channels = spark.createDataFrame(
        [(1, "https://www.youtube.com/@known"), (2, "https://www.youtube.com/@lost"), (3, "https://www.youtube.com/channel/UCa"), (4, "https://e.com/feed.xml")],
        "id long, url string",
    )
    pages = spark.createDataFrame(
        [("https://www.youtube.com/@known", '{"channelId":"UCk-1"}'), ("https://e.com/feed.xml", '"externalId":"UCno"')], "url string, html string"
    )
    got = {r.id: (r.channel_id, r.feed_url) for r in feeds.channel_feeds(channels, pages=pages).collect()}
    prefix = "https://www.youtube.com/feeds/videos.xml?channel_id="
    assert got == {
        1: ("UCk-1", prefix + "UCk-1"), 2: (None, "https://www.youtube.com/@lost"), 3: ("UCa", prefix + "UCa"), 4: (None, "https://e.com/feed.xml"),
    }


def test_blog_content_prefers_page_text(spark, landed):
    pages = spark.createDataFrame([("https://e.com/1", "full"), ("https://e.com/3", "")], "url string, page_text string")
    got = {r.title: r.content for r in feeds.blog_entries(landed.filter("feed_url = 'rss'"), pages).collect()}
    assert got == {"One & only": "full", "No Title": "", "Updated": ""}


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text("<broken")
    landed = feeds.landed_feed_files(spark, str(tmp_path))
    assert feeds.feed_entries(landed).count() == 3
    assert feeds.unreadable_feeds(landed).count() == 1


def test_channel_config(spark, tmp_path):
    path = tmp_path / "channels.json"
    path.write_text(json.dumps({"channels": [{"name": "a", "channel_id": "UC1", "description": "d"}, {"name": "b"}, {"name": "c", "channel_id": ""}]}, indent=1))
    assert [r.channel_id for r in tables.read_channels(spark, str(path)).collect()] == ["UC1"]
    assert tables.read_channels(spark, str(tmp_path / "missing.json")).count() == 0


SOURCE = "id long, name string, source_type string, url string, active boolean"


def test_ingest_of_all_and_of_one_source(spark, landed):
    sources = spark.createDataFrame(
        [(1, "v", "youtube", "https://www.youtube.com/channel/UC1", True), (2, "b", "blog", "https://b.org/feed", True),
         (3, "p", "blog", "https://p.org/post", True), (4, "o", "openai", "rss", True), (5, "off", "blog", "https://off.org/feed", False)],
        SOURCE,
    )
    documents = landed.withColumn("feed_seq", F.lit(0).cast("long")).withColumn(
        "feed_url", F.when(F.col("feed_url") == "rss", F.lit("https://b.org/feed")).otherwise(F.col("feed_url"))
    )
    page = spark.createDataFrame([("https://p.org/post", "<h1>P</h1><article>" + "word " * 40 + "</article>")], "url string, html string")
    store = spark.createDataFrame([("https://e.com/3",)], "url string")
    labelled = ingest.ingest(sources, documents, page, store, "2024-01-03", 24)
    got = {r.url: (r.source_id, r.outcome, r.video_id) for r in labelled.collect()}
    assert got == {
        "https://www.youtube.com/watch?v=dQw4w9WgXcQ": (1, "created", "dQw4w9WgXcQ"), "https://e.com/1": (2, "created", None),
        "": (2, "created", None), "https://e.com/3": (2, "duplicate", None), "https://p.org/post": (3, "created", None),
    }
    stats = ingest.stats(labelled, sources).first()
    assert (stats.sources_processed, stats.articles_found, stats.articles_new, stats.articles_duplicate, stats.errors) == (3, 5, 4, 1, 0)
    assert ingest.ingest(sources, documents, page, store, "2024-01-03", 24, source_id=3).count() == 1
    assert ingest.ingest(sources, documents, page, store, "2024-02-03", 24, source_id=1).count() == 0
    again = ingest.ingest(sources, documents, page, ingest.new_articles(labelled, "2024-01-03").select("url").union(store), "2024-01-03", 24)
    assert again.filter("outcome = 'created'").count() == 0


def test_article_sink_and_feature_sink(spark, tmp_path):
    articles = schemas.as_table(
        spark.sql("select 1L id, 1L source_id, 't' title, 'u' url, timestamp_ntz'2024-01-02 03:00:00' scraped_at"), "articles"
    )
    path = str(tmp_path / "articles")
    tables.append_articles(articles, path)
    tables.append_articles(articles.withColumn("id", F.lit(2).cast("long")).withColumn("scraped_at", F.lit("2024-01-05").cast("timestamp_ntz")), path)
    back = tables.read_articles(spark, path)
    assert back.count() == 2
    pruned = back.filter(F.col("scraped_date") >= F.lit("2024-01-04").cast("date"))
    assert "PartitionFilters: [isnotnull(scraped_date" in pruned._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in pruned.collect()] == [2]

    features = spark.createDataFrame([(1, "m", "s"), (2, "m", "s")], "article_id long, model string, summary string")
    target = str(tmp_path / "summaries")
    tables.append_features(features.filter("article_id = 1"), features.limit(0), target)
    tables.append_features(features, spark.read.parquet(target), target)
    assert sorted(r.article_id for r in spark.read.parquet(target).collect()) == [1, 2]
    tables.append_features(features.withColumn("model", F.lit("m2")), spark.read.parquet(target), target, model="m2")
    assert spark.read.parquet(target).count() == 4

    tables.append_log(features, str(tmp_path / "log"))
    tables.append_log(features, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    tables.export_json(features, str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).first()[0])["model"] == "m"
    assert tables.scan(spark, "article_summaries", target).columns == schemas.ARTICLE_SUMMARIES.names


def test_dry_run_writes_nothing(spark, tmp_path):
    """Operators only return plans; nothing lands anywhere unless a sink is called."""
    from feedmill.operators.state import enqueue_plan

    enqueue_plan(spark.createDataFrame([(1,), (None,)], "id long")).collect()
    assert list(tmp_path.iterdir()) == []


def test_status_labels_are_folded(spark):
    rows = spark.createDataFrame([("PENDING",), (" Failed ",), ("odd",), (None,)], "status string")
    got = schemas.normalise_enum(rows, "status", schemas.ALLOWED_VALUES["processing_queue", "status"]).collect()
    assert [tuple(r) for r in got] == [("pending", True), ("failed", True), ("odd", False), (None, False)]


def test_pages_landed_twice_count_once(spark):
    from feedmill.plans.ingest import ingest
    from feedmill.sources.feeds import channel_feeds
    from feedmill.sources.pages import first_landed

    sources = spark.createDataFrame(
        [(1, "Blog", "blog", "https://e.com/post", True), (2, "Same", "blog", "https://e.com/post", True)],
        "id long, name string, source_type string, url string, active boolean",
    )
    page = "<h1>Post</h1><article>" + "A sentence that stands here. " * 5 + "</article>"
    pages = spark.createDataFrame([("https://e.com/post", page), ("https://e.com/post", page), ("https://e.com/post", page + " ")], "url string, html string")
    feeds = spark.createDataFrame([], "feed_url string, feed_seq long, xml string")
    store = spark.createDataFrame([], "url string")
    got = sorted((r.source_id, r.outcome) for r in ingest(sources, feeds, pages, store, "2024-01-31").collect())
    assert got == [(1, "created"), (2, "duplicate")]

    texts = spark.createDataFrame([("u", 2, "b"), ("u", 1, "z"), ("u", 0, None), ("v", 5, None)], "url string, page_id long, page_text string")
    assert [tuple(r) for r in first_landed(texts, "page_text").collect()] == [("u", "z")]

    handle = "https://www.youtube.com/@some"
    html = '<link rel="canonical" href="https://www.youtube.com/channel/UC' + "a" * 22 + '"><script>"channelId":"UC' + "a" * 22 + '"</script>'
    twice = spark.createDataFrame([(handle, html), (handle, html)], "url string, html string")
    assert channel_feeds(spark.createDataFrame([(1, handle)], "id long, url string"), pages=twice).count() == 1
