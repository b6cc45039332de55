import pytest
from pyspark.sql import functions as F

from feedmill.plans import daily
from feedmill.plans.daily import Store, daily_run
from feedmill.session import staged


def test_daily_run_ingests_delivers_and_audits_once(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    item = "<item><title>T{0}</title><link>https://b.org/{0}</link><pubDate>Tue, 02 Jan 2024 0{0}:00:00 GMT</pubDate><description>Some text {0}. More of it!</description></item>"
    xml = "<rss><channel>" + "".join(item.format(i) for i in range(7)) + item.format(3) + "</channel></rss>"
    feeds = spark.createDataFrame([("https://b.org/feed", 0, xml)], "feed_url string, feed_seq long, xml string")
    pages = spark.createDataFrame([], "url string, html string")
    sources = spark.createDataFrame([(1, "B", "blog", "https://b.org/feed", True)], "id long, name string, source_type string, url string, active boolean")
    subscribers = spark.createDataFrame([(1, "a@b.co", "A", True), (2, "broken", "B", True)], "id long, email string, name string, is_active boolean")
    run = lambda **o: daily_run(spark, store, sources, feeds, pages, subscribers, "2024-01-02 12:00:00", 24, **o)

    assert run(dry_run=True)["articles_new"] == 7
    assert not (tmp_path / "store").exists()
    stats = run()
    assert (stats["articles_found"], stats["articles_new"], stats["articles_duplicate"], stats["sources_processed"]) == (8, 7, 1, 1)
    read = lambda t: spark.read.parquet(store.path(t))
    section = read("digest_sections").first()
    assert (section.source_name, section.n_items) == ("B", 5) and "T6" in section.text_body and "T1\n" not in section.text_body
    assert {(r.subscription_id, r.status, r.articles_count) for r in read("email_deliveries").collect()} == {(1, "sent", 5), (2, "failed", 5)}
    again = run()
    assert (again["articles_new"], again["articles_duplicate"]) == (0, 8)
    audits = read("pipeline_runs").orderBy(F.desc("articles_processed")).collect()
    assert [(r.articles_processed, r.articles_failed, r.articles_skipped) for r in audits] == [(7, 1, 1), (0, 0, 8)]
    assert read("email_deliveries").count() == 2


def test_staged_rows_are_read_back_in_full(spark):
    rows = spark.range(100).withColumn("x", F.col("id") * 2)
    kept = staged(rows, "numbers")
    assert kept.schema == rows.schema or kept.dtypes == rows.dtypes
    assert kept.agg(F.sum("x")).first()[0] == 9900


class Stopped(Exception):
    pass


class StopsAt(daily.Ledger):
    """Stops once at a step: before its entry is written, or right after."""

    def __init__(self, spark, store, step, noted):
        super().__init__(spark, store)
        self.step, self.noted = step, noted

    def enter(self, run, step, content=None):
        if step != self.step or self.noted:
            super().enter(run, step, content)
        if step == self.step:
            raise Stopped


def inputs(spark):
    item = "<item><title>T{0}</title><link>https://b.org/{0}</link><pubDate>Tue, 02 Jan 2024 0{0}:00:00 GMT</pubDate><description>Some text {0}. More of it!</description></item>"
    xml = "<rss><channel>" + "".join(item.format(i) for i in range(4)) + "</channel></rss>"
    feeds = spark.createDataFrame([("https://b.org/feed", 0, xml)], "feed_url string, feed_seq long, xml string")
    sources = spark.createDataFrame([(1, "B", "blog", "https://b.org/feed", True)], "id long, name string, source_type string, url string, active boolean")
    subscribers = spark.createDataFrame([(1, "a@b.co", "A", True), (2, "broken", "B", True)], "id long, email string, name string, is_active boolean")
    return sources, feeds, spark.createDataFrame([], "url string, html string"), subscribers


@pytest.mark.parametrize("step, noted", [("intent", False), ("intent", True), ("articles", False), ("items", False), ("sections", False), ("deliveries", False), ("deliveries", True), ("audit", False)])
def test_a_stop_at_any_step_sends_exactly_one_digest(spark, tmp_path, step, noted):
    store = Store(str(tmp_path / "store"))
    run = lambda at, **o: daily_run(spark, store, *inputs(spark), at, 24, **o)
    with pytest.raises(Stopped):
        run("2024-01-02 12:00:00", ledger=StopsAt(spark, store, step, noted))
    later = step == "articles"  # the next call may be for a later time: it finishes the open run first
    run("2024-01-02 13:00:00" if later else "2024-01-02 12:00:00")
    read = lambda t: spark.read.parquet(store.path(t))
    assert sorted(r.url for r in read("articles").collect()) == [f"https://b.org/{i}" for i in range(4)]
    sent = read("email_deliveries").collect()
    assert sorted((r.subscription_id, r.status, r.articles_count) for r in sent) == [(1, "sent", 4), (2, "failed", 4)]
    assert all(len(r.articles_ids) == 4 and r.created_at is not None for r in sent) and len({r.id for r in sent}) == 2
    assert read("digest_sections").count() == 1
    audits = sorted((r.id, r.articles_processed, r.articles_failed) for r in read("pipeline_runs").collect())
    assert audits[0] == (1, 4, 1) and len(audits) == (2 if later else 1)
    assert daily.Ledger(spark, store).open_run() is None
