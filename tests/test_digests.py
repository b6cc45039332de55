from pyspark.sql import functions as F

from feedmill.operators import assembly
from feedmill.operators.ranking import newest_first, top_keys, top_per_group
from feedmill.plans import digests

ARTICLES = """select * from values
  (1L, 1L, 'A', 'u1', timestamp_ntz'2024-01-02 00:00:00', timestamp_ntz'2024-01-02 00:00:00', 'one'),
  (2L, 1L, 'B', 'u2', cast(null as timestamp_ntz), timestamp_ntz'2024-01-02 00:00:00', 'two'),
  (3L, 2L, 'C', 'u3', timestamp_ntz'2024-01-02 12:00:00', timestamp_ntz'2024-01-02 00:00:00', ''),
  (4L, 3L, 'D', 'u4', timestamp_ntz'2024-01-02 06:00:00', timestamp_ntz'2023-01-02 00:00:00', 'four')
  t(id, source_id, title, url, published_at, scraped_at, content)"""
SOURCES = "select * from values (1L, 'Same'), (2L, 'Same'), (3L, 'Other') t(id, name)"
SUMMARIES = "select * from values (1L, 1L, 'm', 'sum <1>', array('k&1')), (2L, 1L, 'n', 'sum 2', null), (3L, 3L, 'm', 's3', array()) t(id, article_id, model, summary, key_points)"


def frames(spark):
    return spark.sql(ARTICLES), spark.sql(SUMMARIES), spark.sql(SOURCES)


def test_digest_fans_out_and_orders(spark):
    articles, summaries, sources = frames(spark)
    rows = digests.digest(articles, summaries, sources, "2024-01-03", 24).collect()
    assert [(r.id, r.model, r.key_points, r.published_date) for r in rows] == [
        (3, "m", [], "January 02, 2024"), (1, "m", ["k&1"], "January 02, 2024"), (1, "n", [], "January 02, 2024"),
    ]


def test_sources_with_one_name_share_their_places_and_undated_lead(spark):
    articles, _, sources = frames(spark)
    top = digests.top_articles(articles, sources, "2024-01-03", 48, per_source=2).orderBy("position").collect()
    assert [(r.source_name, r.id, r.position) for r in top] == [("Same", 2, 1), ("Same", 3, 2)]


def test_failed_summaries_are_not_replaced(spark):
    articles, _, sources = frames(spark)

    def scorer(prompt):
        if "Title: B" in prompt:
            raise RuntimeError("down")
        return "summary of " + prompt.split("Title: ")[1].split("\n")[0]

    from feedmill.operators import scoring
    from feedmill.plans import digests as d

    chosen = d.scored_digest(articles.filter("id <> 9"), sources, "2024-01-03", 48, per_source=2, scorer=lambda p: scoring.call_with_retry(scorer, p, 1)[0] or "")
    assert [(r.id, r.summary) for r in chosen.collect()] == [(3, "summary of C")]
    bodies = d.section_bodies(d.sections(chosen)).collect()
    assert [(b.source_name, b.n_items) for b in bodies] == [("Same", 1)]
    assert "SAME" in bodies[0].text_body and "Jan 02, 2024" in bodies[0].html_body
    totals = d.digest_totals(chosen).first()
    assert (totals.total_articles, totals.total_sources, totals.success) == (1, 1, True)
    assert d.digest_totals(chosen.limit(0)).first().success is False


def test_parts_escape_html_only(spark):
    parts = digests.digest_parts(digests.digest(*frames(spark), "2024-01-03", 24)).collect()
    first = [p for p in parts if p.id == 1 and p.model == "m"][0]
    assert "sum &lt;1&gt;" in first.html_part and "<li>k&amp;1</li>" in first.html_part
    assert "sum <1>" in first.text_part and "Key Insights:\n  • k&1" in first.text_part
    assert all("Key Insights" not in p.text_part for p in parts if p is not first)


def test_body_is_written_in_order(spark, tmp_path):
    parts = digests.digest_parts(digests.digest(*frames(spark), "2024-01-03", 24))
    digests.write_body(parts, str(tmp_path / "body"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "body").glob("part-*.txt")))
    assert text.index("\nC\n") < text.index("\nA\n")


def test_deliveries(spark):
    subscribers = spark.createDataFrame(
        [(1, "a@b.co", "Ann", True), (2, "bad", None, True), (3, "c@d.co", "", True), (4, "x@y.co", "X", False)],
        "id long, email string, name string, is_active boolean",
    )
    items = digests.digest(*frames(spark), "2024-01-03", 24)
    got = {r.subscription_id: r for r in digests.deliveries(subscribers, items, "2024-01-03").collect()}
    assert {k: (r.reader, r.status, r.articles_count) for k, r in got.items()} == {
        1: ("Ann", "sent", 3), 2: ("Reader", "failed", 3), 3: ("Reader", "sent", 3),
    }
    assert "unsubscribe?email=a@b.co" in got[1].text_tail
    empty = digests.deliveries(subscribers, items.limit(0), "2024-01-03").collect()
    assert {(r.status, r.error_message) for r in empty} == {("failed", "No articles found")}


def test_delivery_frames_close_and_escape(spark):
    people = spark.createDataFrame([(1, "a&\"b@c.co", "Ann", True), (2, None, None, True)], "id long, email string, name string, is_active boolean")
    items = digests.digest(*frames(spark), "2024-01-03", 24)
    for r in digests.deliveries(people, items, "2024-01-03", brand="A <b> & C").collect():
        whole = r.html_head + r.html_tail
        assert all(whole.count(f"<{t}") == whole.count(f"</{t}>") for t in ("html", "body", "div", "h1", "strong"))
        assert "A &lt;b&gt; &amp; C</h1>" in r.html_head and "<strong>3</strong>" in r.html_head and "January 03, 2024" in r.html_head
        link = "#" if r.email is None else "http://localhost:8000/unsubscribe?email=a&amp;&#34;b@c.co"
        assert f'<a href="{link}">Unsubscribe</a> • <a href="' in r.html_tail


def test_body_parts_stand_at_their_starts(spark):
    items = spark.sql("""select * from values (1L, 'One', 'T1', 'u1', timestamp_ntz'2024-01-02 00:00:00', 's <1>', 1), (2L, 'One', 'T2', 'u2', null, 's2', 2),
        (3L, 'Two', 'T3', 'u3', timestamp_ntz'2024-01-03 00:00:00', '😀', 1), (4L, null, 'T4', 'u4', null, 's4', 1) t(id, source_name, title, url, published_at, summary, position)""")
    parts = digests.digest_body(digests.sections(items), "2024-01-03", brand="Mine").collect()
    for kind in ("text", "html"):
        body = ""
        for part in sorted(parts, key=lambda p: p[f"{kind}_start"]):
            assert part[f"{kind}_start"] == len(body)
            body += part[f"{kind}_part"]
        assert body.index("T1") < body.index("T2") < body.index("T3") and "T4" not in body
    text = "".join(p.text_part for p in sorted(parts, key=lambda p: p.text_start))
    bar = "=" * 60
    assert text.startswith(f"{bar}\nMINE\nJanuary 03, 2024\n{bar}\n\n\n📰 ONE\n" + "-" * 60 + "\n\n• T1\n  Jan 02, 2024\n\n  s <1>\n  Read more: u1\n")
    assert text.endswith(f"Read more: u3\n\n\n{bar}\nGenerated by Mine\n{bar}")
    empty = digests.digest_body(digests.sections(items.limit(0)), "2024-01-03").collect()
    assert [p.part for p in sorted(empty, key=lambda p: p.text_start)] == ["opening", "closing"]


def test_top_per_group_limits_before_the_shuffle(spark):
    rows = spark.range(9000, numPartitions=6).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 100).cast("string")).alias("g"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("published_at"),
    )
    top = top_per_group(rows, "g", 2, newest_first())
    assert top.groupBy("g").count().filter("count <> 2").count() == 0
    assert "BroadcastHashJoin" in top._jdf.queryExecution().executedPlan().toString()
    keys = top_keys(rows, "g", 2, newest_first())
    assert keys._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert "WindowGroupLimit" in keys._jdf.queryExecution().executedPlan().toString()


def test_transcripts_in_parts_and_by_language(spark):
    rows = [("v", "de", i, f"d{i}") for i in range(3)] + [("v", "en-US", i, f"e{i}") for i in range(25)] + [("w", "fr", 1, "b"), ("w", "fr", 0, "a")]
    segments = spark.createDataFrame(rows, "video_id string, language string, seq long, text string").repartition(5)
    chosen = assembly.choose_language(segments)
    got = {(r.video_id, r.part): r.content for r in assembly.assemble(chosen, ["video_id"], per_part=10).collect()}
    assert got == {
        ("v", 0): " ".join(f"e{i}" for i in range(10)), ("v", 1): " ".join(f"e{i}" for i in range(10, 20)),
        ("v", 2): " ".join(f"e{i}" for i in range(20, 25)), ("w", 0): "a b",
    }


def test_parts_of_the_prompt_lie_end_to_end(spark, tmp_path):
    from feedmill import fixed_values as fv

    articles, _, sources = frames(spark)
    parts = digests.digest_prompt(digests.top_articles(articles, sources, "2024-01-03", 24 * 400))
    rows = sorted(parts.collect(), key=lambda r: r.start)
    assert [(r.part, r.source_name) for r in rows] == [("opening", None), ("section", "Same"), ("section", "Other"), ("closing", None)]
    for one, other in zip(rows, rows[1:]):
        assert one.start + len(one.text) == other.start
    entry = lambda i, t, u, c: f"{i}. **{t}**\n   URL: {u}\n   Content preview: {c}...\n"
    middle = ["\n## Same\n", entry(1, "B", "u2", "two"), entry(2, "C", "u3", ""), entry(3, "A", "u1", "one"), "\n## Other\n", entry(1, "D", "u4", "four")]
    want = fv.DIGEST_PROMPT_HEAD + "\n\n" + "\n".join(middle) + "\n\n" + fv.DIGEST_PROMPT_TAIL
    assert "".join(r.text for r in rows) == want
    digests.write_prompt(parts, str(tmp_path / "prompt"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "prompt").glob("part-*"))) == want + "\n"


def test_prompt_without_articles(spark):
    from feedmill import fixed_values as fv

    articles, _, sources = frames(spark)
    parts = digests.digest_prompt(digests.top_articles(articles.limit(0), sources, "2024-01-03", 48)).orderBy("start").collect()
    assert "".join(r.text for r in parts) == f"{fv.DIGEST_PROMPT_HEAD}\n\n\n\n{fv.DIGEST_PROMPT_TAIL}"


def test_running_total_over_many_stretches(spark):
    from feedmill.operators.ranking import running_total

    rows = spark.range(0, 5000, 1, 5).selectExpr("id", "id * 7919 % 5000 as place", "id % 11 as size")
    got = {r.place: (r.size, r.start) for r in running_total(rows, [F.col("place").desc()], "size", "start").collect()}
    total = 0
    for place in range(4999, -1, -1):
        size, start = got[place]
        assert start == total
        total += size
