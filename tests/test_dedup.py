from pyspark.sql import functions as F

from feedmill.operators import dedup

BATCH = "ingest_seq long, source_id long, title string, url string"
STORE = "url string"


def counts(spark, batch, store=()):
    rows = spark.createDataFrame(batch, BATCH)
    held = spark.createDataFrame([(u,) for u in store], STORE)
    return tuple(dedup.outcome_counts(dedup.label_candidates(rows, held)).first())


def test_unique_urls_are_all_created(spark):
    assert counts(spark, [(i, 1, f"t{i}", f"https://e.com/{i}") for i in range(3)]) == (3, 0, 0)


def test_same_url_twice_in_a_batch(spark):
    assert counts(spark, [(1, 1, "a", "https://e.com/x"), (2, 1, "b", "https://e.com/x")]) == (1, 1, 0)


def test_store_wins_over_batch(spark):
    batch = [(i, 1, "t", u) for i, u in enumerate(["https://e.com/old", "https://e.com/1", "https://e.com/2"])]
    assert counts(spark, batch, ["https://e.com/old"]) == (2, 1, 0)


def test_first_in_order_wins_and_errors_are_counted(spark):
    batch = [(3, 1, "late", "u"), (2, 1, "early", "u"), (1, 1, None, "u"), (4, None, "x", "v")]
    rows = dedup.insert_new(spark.createDataFrame(batch, BATCH), spark.createDataFrame([], STORE)).collect()
    assert [(r.ingest_seq, r.title) for r in rows] == [(2, "early")]
    assert counts(spark, batch) == (1, 1, 2)


def test_second_run_creates_nothing(spark):
    batch = spark.createDataFrame([(i, 1, "t", f"u{i % 4}") for i in range(10)], BATCH)
    first = dedup.insert_new(batch, spark.createDataFrame([], STORE))
    assert first.count() == 4
    assert dedup.insert_new(batch, first.select("url")).count() == 0


def test_empty_url_is_a_key_like_any_other(spark):
    assert counts(spark, [(1, 1, "a", ""), (2, 1, "b", "")]) == (1, 1, 0)


def test_a_third_of_all_rows_sharing_one_url_stays_spread(spark):
    rows = spark.range(30000, numPartitions=8).select(
        F.col("id").alias("ingest_seq"), F.lit(1).cast("long").alias("source_id"), F.lit("t").alias("title"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id"))).alias("url"),
    )
    labelled = dedup.label_candidates(rows, spark.createDataFrame([("u1",)], STORE))
    assert tuple(dedup.outcome_counts(labelled).first()) == (20000, 10000, 0)
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_copies(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "doc_id long, text string")
    assert {(r.first_doc_id, r.copies) for r in dedup.copy_groups(docs).collect()} == {(1, 3), (2, 1)}
    assert {r.doc_id for r in dedup.label_copies(docs).filter("is_duplicate").collect()} == {3, 4}
