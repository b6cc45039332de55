import json

from pyspark.sql import functions as F

from feedmill.operators import scoring


def test_offline_scorer_reads_the_whole_text():
    text = "Short. " + "A much longer sentence stands here. " + "Mid one here. " + "The very longest sentence of them all is at the end!"
    got = json.loads(scoring.longest_sentences(text))
    assert got["summary"] == "A much longer sentence stands here. Mid one here. The very longest sentence of them all is at the end!"
    assert len(got["key_points"]) == 3
    assert json.loads(scoring.longest_sentences("")) == {"summary": "", "key_points": []}


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return "ok"

    assert scoring.call_with_retry(flaky, "p", sleep=waits.append) == ("ok", 3, None)
    assert waits == [2.0, 2.0]

    def broken(prompt):
        raise ValueError("no")

    waits.clear()
    assert scoring.call_with_retry(broken, "p", attempts=6, sleep=waits.append) == (None, 6, "ValueError: no")
    assert waits == [2.0, 2.0, 4.0, 8.0, 10.0]


def test_failures_become_rows(spark):
    def scorer(prompt):
        if "bad" in prompt:
            raise RuntimeError("down")
        return '{"summary": "' + prompt.upper() + '"}'

    rows = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, None)], "id long, t string")
    got = {r.article_id: r for r in scoring.score(rows, F.col("t"), scorer, "m", attempts=2, wait=(0, 0), spread=3).collect()}
    assert (got[1].summary, got[1].key_points, got[1].model, got[1].attempts, got[1].error) == ("FINE", [], "m", 1, None)
    assert (got[2].summary, got[2].attempts, got[2].error) == (None, 2, "RuntimeError: down")
    assert got[3].summary == ""


def test_encoder_batches_keep_blanks_in_place(spark):
    def encoder(texts):
        return [[len(t), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, " "), (3, None), (4, "x" * 6000)], "id long, t string")
    got = {r.article_id: r.embedding for r in scoring.embed(rows, "t", encoder, "m").collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: None, 4: [6000.0, 1.0]}

    def broken(texts):
        raise RuntimeError("no model")

    assert {r.embedding for r in scoring.embed(rows, "t", broken, "m").collect()} == {None}


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "c B a"), (3, "\n"), (4, "zebra")], "id long, t string")
    got = {r.article_id: r.embedding for r in scoring.embed(rows, "t").collect()}
    assert got[1] == got[2] and got[3] is None and len(got[4]) == 384
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-5


def test_outcome_events(spark):
    outcomes = spark.createDataFrame(
        [(1, "extraction", "success", None), (2, "summarization", "skipped", None), (3, "embedding", "success", None), (4, "embedding", "failed", "e")],
        "article_id long, stage string, outcome string, error_message string",
    )
    got = {r.article_id: (r.status, r.stage, r.error, r.queue_name) for r in scoring.outcome_events(outcomes, 100, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert got == {
        1: ("pending", "summarization", None, None), 2: ("pending", "embedding", None, None),
        3: ("completed", "embedding", None, None), 4: ("failed", "embedding", "e", "embedding"),
    }


def test_vectors_read_whole_texts(spark):
    head = "word " * 3000
    rows = spark.createDataFrame([(1, head + "alpha"), (2, head + "beta")], "id long, text string")
    whole = {r.id: r.embedding for r in scoring.hashed_vectors(rows, "text").collect()}
    cut = {r.id: r.embedding for r in scoring.hashed_vectors(rows, "text", limit=5000).collect()}
    assert whole[1] != whole[2] and cut[1] == cut[2]
