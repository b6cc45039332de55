from pyspark.sql import functions as F

from feedmill.operators import filters, gates, joins

ARTICLE = "id long, content string, full_content string"


def test_extraction_gate_is_strict(spark):
    rows = [(1, "c", None), (2, "c", "x" * 100), (3, "c", "x" * 101), (4, "c", "x" * 150)]
    got = {r.id: r.next_stage for r in gates.extraction_gate(spark.createDataFrame(rows, ARTICLE)).collect()}
    assert got == {1: "extraction", 2: "extraction", 3: "summarization", 4: "summarization"}


def test_summary_gate(spark):
    rows = [
        (1, None, "Too short"), (2, None, None), (3, None, "y" * 200), (4, "z" * 60, ""), (5, "z" * 60, None),
        (6, None, "y" * 49), (7, None, "y" * 50), (8, "z" * 60, "short"),
    ]
    got = gates.summary_gate(spark.createDataFrame(rows, ARTICLE)).collect()
    assert {r.id for r in got if r.accepted} == {3, 4, 5, 7}
    assert {r.reason for r in got if not r.accepted} == {"Insufficient content"}


def test_embedding_gate_takes_an_existing_summary_even_when_empty(spark):
    articles = spark.createDataFrame([(1, "c" * 20, None), (2, "c" * 20, None), (3, "c" * 9, None), (4, "c" * 10, "")], ARTICLE)
    summaries = spark.createDataFrame(
        [(10, 1, "m", "", None), (11, 1, "m", "a long enough summary", None)],
        "id long, article_id long, model string, summary string, key_points array<string>",
    )
    got = {r.id: r.accepted for r in gates.embedding_gate(articles, joins.one_summary(summaries)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_blank_text_is_not_embeddable(spark):
    df = spark.createDataFrame([("a",), (" \n\t",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(gates.embeddable(F.col("t"))).collect()] == ["a", None, None, None]


def test_routes(spark):
    df = spark.createDataFrame([("video", "v"), ("video", None), ("article", None), ("x", "v")], "kind string, v string")
    got = df.select(gates.declared_route(F.col("kind"), F.col("v")).alias("r"), gates.extraction_route(F.col("v")).alias("m"))
    assert [tuple(r) for r in got.collect()] == [
        ("transcript", "transcript"), (None, "page"), ("page", "page"), (None, "transcript"),
    ]


def test_windows_are_inclusive_and_treat_missing_dates(spark):
    rows = spark.sql(
        "select * from values (1, timestamp_ntz'2024-01-30 00:00:00'), (2, timestamp_ntz'2024-01-29 23:59:59'), (3, null) t(id, published_at)"
    ).withColumn("scraped_at", F.col("published_at"))
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(filters.published_within(rows, "2024-01-31", 24)) == {1}
    assert ids(filters.published_within(rows, "2024-01-31", 24, keep_undated=True)) == {1, 3}
    assert ids(filters.scraped_within(rows, "2024-01-31", 24)) == {1}


def test_window_filter_reaches_the_scan(spark, tmp_path):
    rows = spark.sql("select id, timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int)) as scraped_at from range(100)")
    path = str(tmp_path / "a")
    rows.write.parquet(path)
    found = filters.scraped_within(spark.read.parquet(path), "2024-01-05", 24)
    assert "PushedFilters: [IsNotNull(scraped_at), GreaterThanOrEqual(scraped_at" in found._jdf.queryExecution().executedPlan().toString()
