import zlib

import numpy as np

from feedmill.llm import quality, queries


def test_risk_separates_and_stays_non_negative():
    r = np.random.default_rng(1)
    good = r.normal(size=(9000, 6)) + [2, 0, 0, 0, 0, 0]
    bad = r.normal(size=(4000, 6)) - [2, 0, 0, 0, 0, 0]
    model = quality.fit_risk(good[:5000], np.concatenate([good[5000:], bad[:2000]]), 2 / 3)
    assert (model.scores(good[:5000]) > 0.5).mean() > 0.95 and (model.scores(bad[2000:]) < 0.5).mean() > 0.9
    assert (quality.fit_risk(good[:0], bad, 0.5).scores(bad) == 0.5).all()


def test_features_of_long_and_empty_texts(monkeypatch):
    data = ("Some words, and the the rest!\nline\n" * 300).encode()
    whole = quality.features(data)
    monkeypatch.setattr(quality, "PIECE", 500)
    parts = quality.features(data)
    assert np.abs(whole - parts).max() < 0.06 and not quality.features(b"").any() and quality.features(b"x").shape == (quality.DIMENSION,)


def test_rows_and_labels(spark):
    rows = [(i, "Plain words of a good text here and there." if i % 3 else "BAD!!! BAD!!! BAD!!!", "s") for i in range(300)]
    rows += [(None, "text", "s"), (5, None, "s"), (5, "", "s"), (7, "x" * 100000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    out = quality.score(df, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    bad = [r.score for r in out if r.text and r.text.startswith("BAD")]
    good = [r.score for r in out if r.text and r.text.startswith("Plain")]
    assert max(bad) < 0.3 < min(good)
    assert (quality.score(df, quality.fit(df, labels.limit(0))).select("score").distinct().head()[0]) == 0.5
    assert quality.score(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES["op3_quality"].run(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in out)
    own = [(labels[r.doc_id], r.score) for r in out if r.held_out and r.doc_id in labels]
    good, bad = np.array([s for y, s in own if y]), np.array([s for y, s in own if not y])
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    print("held out", len(own), "auc", auc, "good kept", (good >= 0.3).mean(), "bad gone", (bad < 0.3).mean())
    assert auc > 0.97 and (good >= 0.3).mean() > 0.98 and (bad < 0.3).mean() > 0.85


def test_an_id_with_several_texts_teaches_the_same_in_any_order(spark):
    rows = [(i, f"Plain words {i} here." if i % 3 else f"BAD!!! {i}", 1) for i in range(60)] + [(i, f"Other text {i}!", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    one, other = (quality.fit(df.orderBy(order).repartition(n), labels) for order, n in (("text", 2), ("doc_id", 5)))
    assert one.prior == other.prior and np.allclose(one.weights, other.weights, rtol=1e-3, atol=1e-3)
