from pyspark.sql import functions as F

from feedmill.plans import subscriptions

AS_OF = "2024-01-31 00:00:00"


def subscribers(spark, filters):
    rows = [(i, f"r{i}@example.com", None, True, f) for i, f in enumerate(filters)] + [(99, "off@example.com", None, False, [1])]
    return spark.createDataFrame(rows, "id long, email string, name string, is_active boolean, source_filters array<long>")


def keys(spark, pairs):
    return spark.createDataFrame([(i, "m", s) for i, s in pairs], "id long, model string, source_id long")


def test_null_empty_repeated_unknown_and_overlapping_filters(spark):
    people = subscribers(spark, [None, [], [None], [1], [2, 1, 1, None], [3], [10, 2]])
    items = keys(spark, [(1, 1), (2, 1), (3, 2), (4, 10), (4, 10)])
    rows = {r.subscription_id: r for r in subscriptions.filtered_deliveries(people, items, AS_OF).collect()}
    assert {i: r.articles_count for i, r in rows.items()} == {0: 5, 1: 5, 2: 5, 3: 2, 4: 3, 5: 0, 6: 3}
    assert [rows[i].filter_set for i in range(7)] == ["", "", "", "1", "1,2", "3", "2,10"]
    assert rows[5].status == "failed" and rows[5].error_message == "No articles found" and rows[3].status == "sent"
    index = subscriptions.filter_index(people)
    log = {r.subscription_id: r.articles_ids for r in subscriptions.delivery_log(subscriptions.filtered_deliveries(people, items, AS_OF), subscriptions.set_articles(index, items)).collect()}
    assert log == {0: [1, 2, 3, 4], 1: [1, 2, 3, 4], 2: [1, 2, 3, 4], 3: [1, 2], 4: [1, 2, 3], 5: [], 6: [3, 4]}
    assert len({r.id for r in rows.values()}) == 7


def test_an_empty_digest_is_not_sent_and_no_subscribers_give_no_rows(spark):
    people = subscribers(spark, [None, [1]])
    rows = subscriptions.filtered_deliveries(people, keys(spark, [(1, 1)]).limit(0), AS_OF).collect()
    assert {(r.articles_count, r.status) for r in rows} == {(0, "failed")}
    assert subscriptions.filtered_deliveries(people.limit(0), keys(spark, [(1, 1)]), AS_OF).count() == 0


def test_one_set_and_one_source_hold_most(spark):
    people = spark.range(2000).select(
        "id", F.concat(F.lit("r"), "id", F.lit("@example.com")).alias("email"), F.lit(None).cast("string").alias("name"), F.lit(True).alias("is_active"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit(1).cast("long"))).otherwise(F.array((F.col("id") % 7).cast("long"), F.lit(1).cast("long"))).alias("source_filters"),
    )
    items = spark.range(3000).select("id", F.lit("m").alias("model"), F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 7).cast("long").alias("source_id"))
    per_source = {r.source_id: r["count"] for r in items.groupBy("source_id").count().collect()}
    rows = subscriptions.filtered_deliveries(people, items, AS_OF).collect()
    assert all(r.articles_count == sum(per_source.get(int(s), 0) for s in r.filter_set.split(",")) for r in rows) and len(rows) == 2000


def test_the_log_makes_a_text_once_per_set_and_cuts_a_large_set(spark, monkeypatch):
    monkeypatch.setattr(subscriptions, "DELIVERIES_PER_SLOT", 3)
    people = subscribers(spark, [None] * 10 + [[1]] * 4 + [[3]])
    items = keys(spark, [(1, 1), (2, 1), (3, 2)])
    deliveries = subscriptions.filtered_deliveries(people, items, AS_OF)
    made = lambda ids: F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
    log = subscriptions.delivery_log(deliveries, subscriptions.set_articles(subscriptions.filter_index(people), items), made, extra=["filter_set", "status"])
    rows = {r.subscription_id: (r.filter_set, r.articles_ids, r.status) for r in log.collect()}
    assert log.count() == len(rows) == 15
    assert rows == {i: ("", "1,2,3", "sent") for i in range(10)} | {i: ("1", "1,2", "sent") for i in range(10, 14)} | {14: ("3", "", "failed")}
    assert {r.slots for r in subscriptions._slots(deliveries).collect()} == {4, 2, 1}
