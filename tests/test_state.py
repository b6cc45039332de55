from pyspark.sql import functions as F

from feedmill.functions.dates import literal_time
from feedmill.operators import changes, joins, state

EVENT = "event_id long, ts timestamp_ntz, article_id long, status string, stage string, error string, queue_name string, model string"


def events(spark, rows):
    parts = [
        f"({i}, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, {minute}), {article}, '{status}', "
        + ", ".join("null" if v is None else f"'{v}'" for v in (stage, error, queue, model)) + ")"
        for i, minute, article, status, stage, error, queue, model in rows
    ]
    names = EVENT.replace(" long", "").replace(" timestamp_ntz", "").replace(" string", "")
    return spark.sql(f"select cast(event_id as long) event_id, ts, cast(article_id as long) article_id, status, stage, "
                     f"cast(error as string) error, cast(queue_name as string) queue_name, cast(model as string) model "
                     f"from values {', '.join(parts)} t({names})")


LOG = [
    (1, 0, 1, "extracting", "extraction", None, None, None),
    (2, 1, 1, "failed", None, "e1", "extraction", None),
    (3, 70, 1, "failed", None, "e2", "extraction", None),
    (4, 70, 1, "failed", None, "e3", None, None),
    (5, 200, 1, "failed", None, "e4", "summarization", "m"),
    (6, 0, 2, "pending", "summarization", None, None, None),
    (7, 5, 2, "pending", "embedding", None, None, None),
]


def test_state_keeps_last_stage_and_counts_errors(spark):
    got = {r.article_id: r for r in state.article_state(events(spark, LOG)).collect()}
    assert (got[1].status, got[1].current_stage, got[1].retry_count, got[1].error_message) == ("failed", "extraction", 4, "e4")
    assert (got[2].status, got[2].current_stage, got[2].retry_count, got[2].error_message) == ("pending", "embedding", 0, None)


def test_every_failure_past_the_limit_is_a_dead_letter(spark):
    letters = state.dead_letters(events(spark, LOG)).orderBy("id").collect()
    assert [(r.id, r.queue_name, r.retry_count) for r in letters] == [(4, "unknown", 3), (5, "summarization", 4)]
    assert [r.id for r in state.dead_letters(events(spark, LOG), first_only=True).collect()] == [4]


def test_folding_in_two_steps_equals_one(spark):
    log = events(spark, LOG)
    middle = literal_time("2024-01-01 01:00:00")
    folded = state.fold_state(state.article_state(log.filter(F.col("ts") < middle)), log.filter(F.col("ts") >= middle))
    assert sorted(folded.collect()) == sorted(state.article_state(log).select(*folded.columns).collect())


def test_a_hot_article_is_counted_in_many_tasks(spark):
    """Half of all failures belong to one article, a third of them at the same moment."""
    rows = spark.range(20000, numPartitions=8).select(
        F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.when(F.col("id") % 3 == 0, F.lit(30)).otherwise(F.pmod(F.xxhash64("id"), F.lit(6000))).cast("int"))).alias("ts"),
        F.when(F.col("id") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("id") % 50).alias("article_id"),
    ).persist()
    counted = state.running_count(rows, "article_id", "ts", "event_id", "n")
    hot = [r.n for r in counted.filter("article_id = 0").orderBy("ts", "event_id").select("n").collect()]
    assert hot == list(range(1, 10001))
    assert counted.count() == 20000
    stretches = rows.repartitionByRange(8, "article_id", "ts", "event_id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in stretches.collect()) < 5000
    rows.unpersist()


def test_replay_plan_and_marking(spark):
    letters = spark.sql("""
      select cast(id as long) id, cast(article_id as long) article_id, queue_name, struct(cast(article_id as long) as article_id, 'm' as model) payload,
        'e' error_message, 3L retry_count, timestamp_ntz'2024-01-01' failed_at, cast(null as timestamp_ntz) replayed_at, false replayed
      from values (1, 7, 'extraction'), (2, 7, 'summarization'), (3, null, 'embedding'), (4, 7, 'unknown') t(id, article_id, queue_name)""")
    plan = state.replay_plan(letters)
    got = {r.id: (r.target_queue, r.model, r.skip_reason) for r in plan.collect()}
    assert got == {
        1: ("extraction", None, None), 2: ("summarization", "m", None), 3: (None, None, "article deleted"),
        4: (None, None, "unknown queue"),
    }
    marked = changes.mark_replayed(letters, plan, "2024-02-01")
    assert {r.id for r in marked.collect() if r.replayed} == {1, 2}
    assert state.search_dead_letters(marked).count() == 2
    assert state.search_dead_letters(marked, include_replayed=True, queue="extraction").count() == 1
    assert state.search_dead_letters(marked, ids=[1, 3]).count() == 2
    assert state.search_dead_letters(marked, since="2024-01-02").count() == 0


def test_backfill_stage_rules():
    assert state.backfill_stage("m", None, None) == "summarization"
    assert state.backfill_stage(None, "2024-01-01", None) == "extraction"
    assert state.backfill_stage("m", "2024-01-01", None) == "extraction"
    assert state.backfill_stage("m", None, "embedding") == "embedding"
    for bad in ((None, None, None), ("m", None, "email")):
        try:
            state.backfill_stage(*bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_reset_adds_and_replaces(spark):
    current = state.article_state(events(spark, LOG))
    keys = spark.createDataFrame([(1,), (9,), (9,)], "article_id long")
    got = {r.article_id: r for r in changes.reset_for_stage(current, keys, "embedding").collect()}
    assert set(got) == {1, 2, 9}
    for key in (1, 9):
        assert (got[key].status, got[key].current_stage, got[key].retry_count, got[key].error_message) == ("pending", "embedding", 0, None)


def test_clear_failed(spark):
    current = state.article_state(events(spark, LOG))
    assert state.clear_failed(current).count() == 1
    assert state.clear_failed(current, "embedding").count() == 2
    assert state.clear_failed(current, "extraction").count() == 1
    assert state.clear_failed(current, "no such queue").count() == 2


def test_referential_actions(spark):
    children = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id long, article_id long")
    parents = spark.createDataFrame([(10,)], "id long")
    assert [r.id for r in changes.cascade(children, parents).collect()] == [1]
    assert {(r.id, r.article_id) for r in changes.set_null(children, parents).collect()} == {(1, 10), (2, None), (3, None)}
    assert {r.id for r in changes.orphans(children, parents).collect()} == {2, 3}


def test_subscription_log(spark):
    subs = spark.createDataFrame([(1, "a@b.co", "daily", True), (2, "c@d.co", "daily", True)], "id long, email string, frequency string, is_active boolean")
    log = spark.createDataFrame(
        [(1, 1, "unsubscribe", None), (1, 3, "frequency", "weekly"), (1, 2, "reactivate", None), (1, 4, "unsubscribe", None), (9, 1, "unsubscribe", None)],
        "id long, seq long, action string, frequency string",
    )
    got = {r.id: (r.frequency, r.is_active) for r in changes.apply_subscription_log(subs, log).collect()}
    assert got == {1: ("weekly", False), 2: ("daily", True)}
    requests = spark.createDataFrame([(1, "a@b.co"), (2, "bad"), (3, "n@e.co"), (4, "n@e.co")], "request_seq long, email string")
    outcome = {r.request_seq: r.outcome for r in changes.new_subscriptions(requests, subs).collect()}
    assert outcome == {1: "exists", 2: "invalid", 3: "created", 4: "exists"}


def test_null_keys_are_numbered_like_any_other(spark):
    rows = spark.createDataFrame([(None, i, i) for i in range(40)] + [(1, i, i) for i in range(40)], "k long, t long, e long")
    out = state.running_count(rows.repartition(8), "k", "t", "e", "n").collect()
    assert sorted(r.n for r in out if r.k is None) == sorted(r.n for r in out if r.k == 1) == list(range(1, 41))


def test_a_late_event_does_not_replace_newer_state(spark):
    newer = state.article_state(events(spark, [(2, 100, 1, "completed", "embed", None, None, None)]))
    folded = state.fold_state(newer, events(spark, [(1, 1, 1, "pending", "extract", None, None, None)])).collect()
    assert [(r.status, r.current_stage, r.updated_at.hour) for r in folded] == [("completed", "embed", 1)]


def test_summaries_without_id_are_kept(spark):
    rows = [(None, 1, "b", "second"), (None, 1, "a", "first"), (7, 2, "b", "with id"), (None, 2, "a", "without")]
    found = joins.one_summary(spark.createDataFrame(rows, "id long, article_id long, model string, summary string"))
    assert {r.article_id: r.summary for r in found.collect()} == {1: "first", 2: "with id"}


def test_one_summary_sorts_no_wide_rows_and_takes_one_of_repeated_ids(spark):
    rows = [(4, 1, "b", "later"), (3, 1, "a", "low"), (3, 1, "a", "low"), (3, 1, "0", "lowest model"), (9, 2, "a", "only"), (None, None, "b", "x"), (5, None, "a", "no article")]
    rows += [(100 + i, 3, "m", f"s{i}") for i in range(50)]
    summaries = spark.createDataFrame(rows, "id long, article_id long, model string, summary string").repartition(5)
    found = joins.one_summary(summaries)
    assert {r.article_id: r.summary for r in found.collect()} == {1: "lowest model", 2: "only", None: "no article", 3: "s0"}
    assert found.count() == 4 and joins.one_summary(summaries.limit(0)).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ShuffledHashJoin" in plan and "WindowGroupLimit" in plan
