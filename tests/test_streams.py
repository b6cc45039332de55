import datetime

from pyspark.sql import functions as F

from feedmill.operators.state import article_state, dead_letters
from feedmill.plans import views
from feedmill.streaming import stages, state
from feedmill.streaming.batches import read_batches
from feedmill.streaming.tables import file_stream, insert_if_absent, run_available, table_files, without_repeats_within

PAGE = "page_id long, url string, html string"


def html(n):
    return f"<h1>Page {n}</h1><article>{'Sentence number one stands here. ' * 5}Tail {n}.</article>"


def land(spark, path, rows):
    spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(path)


def test_two_landings_and_an_idle_rerun(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "out")
    land(spark, landed, [(i, f"https://e.com/{i}", html(i)) for i in range(4)] + [(9, "https://e.com/1/?again", html(9))])
    layout = stages.run_stages(spark, landed, root)
    count = lambda name: stages.read_stage(spark, layout, name).count()
    assert [count(n) for n in ("bronze", "silver", "gold", "vectors")] == [4, 4, 4, 4]
    land(spark, landed, [(20, "https://e.com/2#x", html(20)), (21, "https://e.com/new", html(21)), (22, "https://e.com/empty", "<p>short</p>")])
    stages.run_stages(spark, landed, root)
    assert [count(n) for n in ("bronze", "silver", "gold", "vectors")] == [6, 5, 5, 5]
    assert {r.id for r in stages.read_stage(spark, layout, "bronze").collect()} == {0, 1, 2, 3, 21, 22}
    stages.run_stages(spark, landed, root)
    assert [count(n) for n in ("bronze", "silver", "gold", "vectors")] == [6, 5, 5, 5]


def test_a_repeated_batch_leaves_the_same_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = insert_if_absent(path, "k", "o")
    schema = "k string, o long"
    first = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], schema)
    second = spark.createDataFrame([("b", 4), ("c", 5)], schema)
    for rows, batch in ((first, 0), (second, 1), (second, 1), (first, 0)):
        sink(rows, batch)
    assert {(r.k, r.o) for r in read_batches(spark, path, first.schema).collect()} == {("a", 1), ("b", 3), ("c", 5)}


def test_streams_equal_batch_over_several_files(spark, small, tmp_path):
    events = views.view(spark, small, "processing_events")
    landed = str(tmp_path / "events")
    # Files land in time order, as a log does.
    for day in range(0, 30, 10):
        start = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
        stop = start + datetime.timedelta(days=10)
        part = events.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(stop).cast("timestamp_ntz")))
        part.coalesce(1).write.mode("append").parquet(landed)
    assert spark.read.parquet(landed).count() == events.count()
    stream = file_stream(spark, landed, events.schema, files_per_batch=1)
    state.update_state(stream, str(tmp_path / "state"), str(tmp_path / "c1"))
    got = state.current_state(spark, str(tmp_path / "state"))
    assert sorted(got.collect()) == sorted(article_state(events).select(*got.columns).collect())

    state.update_dead_letters(file_stream(spark, landed, events.schema, files_per_batch=1), str(tmp_path / "dead"), str(tmp_path / "c2"))
    letters = state.read_dead_letters(spark, str(tmp_path / "dead"))
    assert sorted(letters.collect()) == sorted(dead_letters(events).select(*letters.columns).collect())
    state.update_dead_letters(file_stream(spark, landed, events.schema, files_per_batch=1), str(tmp_path / "dead"), str(tmp_path / "c2"))
    assert state.read_dead_letters(spark, str(tmp_path / "dead")).count() == letters.count()


def test_failed_summaries_are_tried_again_and_models_do_not_exclude_each_other(spark, tmp_path):
    landed, layout = str(tmp_path / "landed"), stages.Layout(str(tmp_path / "out"))
    land(spark, landed, [(i, f"https://e.com/{i}", html(i)) for i in range(3)])
    calls = str(tmp_path / "calls")

    def down(prompt):
        raise RuntimeError("down")

    def counted(prompt):
        with open(calls, "a") as log:
            log.write("x")
        return '{"summary": "fine, and long enough"}'

    def rows(name):
        return stages.read_stage(spark, layout, name)

    stages.ingest_pages(spark, landed, layout)
    stages.extract_stage(spark, layout)
    stages.summary_stage(spark, layout, lambda p: down(p) if "Page 1" in p else counted(p), "m1")
    assert sorted(r.id for r in rows("gold").collect()) == [0, 2]
    assert [(r.id, r.model, r.error) for r in rows("failed").collect()] == [(1, "m1", "RuntimeError: down")]
    for scorer in (down, counted, counted):
        stages.retry_summaries(spark, layout, scorer, "m1")
    assert sorted(r.id for r in rows("gold").collect()) == [0, 1, 2] and rows("failed").count() == 2
    stages.summary_stage(spark, layout, counted, "m2")
    stages.summary_stage(spark, layout, counted, "m2")
    assert sorted((r.id, r.model) for r in rows("gold").collect()) == [(i, m) for i in range(3) for m in ("m1", "m2")]
    assert len(open(calls).read()) == 6


def test_successful_retries_keep_their_own_folders(spark, tmp_path):
    landed, layout = str(tmp_path / "landed"), stages.Layout(str(tmp_path / "out"))

    def down(prompt):
        raise RuntimeError("down")

    def up(prompt):
        return '{"summary": "fine, and long enough"}'

    for n in range(3):
        land(spark, landed, [(n, f"https://e.com/{n}", html(n))])
        stages.ingest_pages(spark, landed, layout)
        stages.extract_stage(spark, layout)
        stages.summary_stage(spark, layout, down, "m1")
        stages.retry_summaries(spark, layout, up, "m1")
        assert sorted(r.id for r in stages.read_stage(spark, layout, "gold").collect()) == list(range(n + 1))


def test_failed_vectors_and_gated_pages_are_outcomes_with_state_retries_and_dead_letters(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "out")

    def down(texts):
        raise RuntimeError("down")

    def up(texts):
        return [[1.0, 2.0] for _ in texts]

    def states(layout):
        return {r.article_id: (r.status, r.current_stage, r.retry_count) for r in state.current_state(spark, layout.table("state")).collect()}

    def letters(layout):
        return sorted((r.article_id, r.queue_name, r.retry_count) for r in state.read_dead_letters(spark, layout.table("letters")).collect())

    land(spark, landed, [(1, "https://e.com/1", html(1)), (2, "https://e.com/2", "<p>short</p>")])
    gated = ("failed", "extraction", 1)
    for n in range(1, state.fv.MAX_RETRIES + 1):
        layout = stages.run_stages(spark, landed, root, encoder=down)
        assert stages.read_stage(spark, layout, "vectors").count() == 0
        assert states(layout) == {1: ("failed", "embedding", n), 2: gated}
    assert letters(layout) == [(1, "embedding", state.fv.MAX_RETRIES)]
    stages.run_stages(spark, landed, root, encoder=up)  # the limit is reached: no further try by itself
    assert stages.read_stage(spark, layout, "vectors").count() == 0 and states(layout)[1] == ("failed", "embedding", 3)
    for _ in range(2):  # a letter is replayed once
        stages.replay(spark, layout, state.read_dead_letters(spark, layout.table("letters")))
        stages.run_stages(spark, landed, root, encoder=up)
        assert [r.id for r in stages.read_stage(spark, layout, "vectors").collect()] == [1]
        assert states(layout) == {1: ("completed", "embedding", state.fv.MAX_RETRIES), 2: gated}
    assert letters(layout) == [(1, "embedding", state.fv.MAX_RETRIES)]


def test_one_article_holds_half_of_the_failures_over_many_batches(spark, tmp_path):
    landed = str(tmp_path / "landed")
    base = datetime.datetime(2024, 1, 1)
    for part in range(4):
        ids = range(part * 500, part * 500 + 500)
        rows = [(i, base + datetime.timedelta(minutes=i // 7), 1 if i % 2 else i % 50, "failed", "extraction", "e", None, "m") for i in ids]
        schema = "event_id long, ts timestamp_ntz, article_id long, status string, stage string, error string, queue_name string, model string"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
    events = spark.read.parquet(landed)
    for _ in range(2):  # an idle rerun adds nothing
        state.update_dead_letters(file_stream(spark, landed, events.schema, files_per_batch=1), str(tmp_path / "dead"), str(tmp_path / "c"), compact_every=2)
        letters = state.read_dead_letters(spark, str(tmp_path / "dead"))
        assert sorted(letters.collect()) == sorted(dead_letters(events).select(*letters.columns).collect())
    totals = {r.article_id: r.retry_count for r in state.totals_table(str(tmp_path / "dead")).read(spark).collect()}
    assert totals[1] == 1000 and sum(totals.values()) == 2000


def test_what_a_batch_reads_does_not_grow_with_the_history(spark, tmp_path, monkeypatch):
    from feedmill.streaming.keyindex import KeyIndex

    opened, real = [], KeyIndex.absent

    def watched(self, rows, before=None):
        found = real(self, rows, before)
        opened.append(len(self.opened))
        return found

    monkeypatch.setattr(KeyIndex, "absent", watched)
    sink = insert_if_absent(str(tmp_path / "t"), "k", "o")
    for batch in range(5):
        rows = [(f"{batch}/{i}", batch * 1000 + i) for i in range(300)] + ([("0/7", 5000 + batch)] if batch == 4 else [])
        sink(spark.createDataFrame(rows, "k string, o long"), batch)
    assert read_batches(spark, str(tmp_path / "t"), spark.createDataFrame([], "k string, o long").schema).count() == 1500
    assert max(opened[:4]) <= 2 and 1 <= opened[4] <= 3  # of up to 128 buckets; the last batch opens that of the known key


def test_repeats_within_the_watermark_never_reach_the_sink(spark, tmp_path):
    landed, at = str(tmp_path / "landed"), datetime.datetime(2024, 1, 1)
    for part in range(3):
        rows = [(f"u{i}", at + datetime.timedelta(minutes=part)) for i in range(4)] + [(f"p{part}", at)]
        spark.createDataFrame(rows, "url string, seen timestamp").coalesce(1).write.mode("append").parquet(landed)
    stream = file_stream(spark, landed, "url string, seen timestamp", files_per_batch=1)
    got = []
    stages.run_available(without_repeats_within(stream, ["url"], "seen", "1 hour"), lambda rows, _: got.extend(r.url for r in rows.collect()), str(tmp_path / "c"))
    assert sorted(got) == ["p0", "p1", "p2", "u0", "u1", "u2", "u3"]


def test_waits_double_between_two_bounds():
    rule = stages.RetryRule(first_wait=10.0, longest_wait=35.0)
    assert [rule.wait(n).total_seconds() for n in (1, 2, 3, 4)] == [10.0, 20.0, 35.0, 35.0]


def test_a_stopped_try_is_done_again_under_its_number(spark, tmp_path, monkeypatch):
    landed, layout = str(tmp_path / "landed"), stages.Layout(str(tmp_path / "out"))
    land(spark, landed, [(1, "https://e.com/1", html(1))])

    def down(prompt):
        raise RuntimeError("down")

    def up(prompt):
        return '{"summary": "fine, and long enough"}'

    stages.ingest_pages(spark, landed, layout)
    stages.extract_stage(spark, layout)
    stages.summary_stage(spark, layout, down, "m", attempts=1)
    with monkeypatch.context() as patched:
        patched.setattr(stages.RetryBook, "note", lambda self, orders, number: (_ for _ in ()).throw(KeyboardInterrupt()))
        try:
            stages.retry_summaries(spark, layout, up, "m", attempts=1)
        except KeyboardInterrupt:
            pass
    stages.retry_summaries(spark, layout, up, "m", attempts=1)
    stages.retry_summaries(spark, layout, up, "m", attempts=1)
    assert [r.id for r in stages.read_stage(spark, layout, "gold").collect()] == [1]
    tries = stages.read_stage(spark, layout, "outcomes").filter("stage = 'summarization'")
    assert sorted(r.outcome for r in tries.collect()) == ["failed", "success"]


def test_a_table_of_one_or_several_files_is_streamed_whole(spark, small, tmp_path):
    from feedmill.plans import catalog

    folder = str(tmp_path / "tables")
    pages = spark.read.parquet(f"{small}/pages.parquet").limit(30)
    pages.repartition(3).write.parquet(f"{folder}/pages.parquet")
    want = {r.page_id for r in pages.collect()}
    layout = stages.Layout(str(tmp_path / "several"))
    stages.ingest_pages(spark, table_files(folder, "pages"), layout)
    assert {r.id for r in stages.read_stage(spark, layout, "bronze").collect()} <= want
    assert catalog.load()["stream_stages"].run(spark, folder).count() > 0
    streamed = file_stream(spark, table_files(folder, "pages"), PAGE), file_stream(spark, table_files(small, "pages"), PAGE)
    for n, (stream, rows) in enumerate(zip(streamed, (pages, spark.read.parquet(f"{small}/pages.parquet")))):
        found = []
        run_available(stream, lambda batch, _: found.append(batch.count()), str(tmp_path / f"checkpoint{n}"))
        assert sum(found) == rows.count()
