import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from feedmill.llm import bpe, simhash
from feedmill.session import staged
from tests.llm.test_decontaminate import brute as brute_items
from tests.llm.test_repeats import brute as brute_repeats
from tests.llm.test_simhash import brute as brute_groups
from tests.llm.test_simhash import plain

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_stage_against_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    names = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    out = dict.fromkeys([n for n, _ in corpus_pipeline.STAGES])
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, docs, medium)
        from feedmill.session import staged

        docs = out[name] = staged(out[name], name)
        assert name == "tokens" or docs.columns == names

    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in out.items()}
    every = {r.doc_id: r for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    gone = set(every) - set(rows["quality"])
    assert sum(labels.get(d) == 1 for d in gone) <= 2
    assert sum(labels.get(d) == 0 for d in rows["quality"]) <= 0.15 * sum(q == 0 for q in labels.values())

    marks = {d: plain(r.text) for d, r in rows["quality"].items()}
    label = brute_groups(list(marks.values()))
    first = {}
    for d in sorted(marks):
        first.setdefault(label[marks[d]], d)
    assert set(rows["near_duplicates"]) == set(first.values())

    ids = sorted(rows["near_duplicates"])
    for d, (size, removed, spans, kept) in zip(ids, brute_repeats([rows["near_duplicates"][d].text.encode() for d in ids], 200)):
        text = rows["repeats"][d].text
        assert len(kept) <= len(text.encode()) <= len(kept) + 6 * spans and rows["repeats"][d].n_chars == len(text)

    sample = [d for i, d in enumerate(sorted(rows["repeats"])) if i % 12 == 0]
    for d, _, _, _, bad in brute_items([(d, rows["repeats"][d].text) for d in sample], items):
        assert bad == (d not in rows["decontamination"])

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(rows["tokens"]) == set(rows["decontamination"])
    for d, r in rows["tokens"].items():
        text = rows["decontamination"][d].text
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == tik.encode_ordinary(text)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows_and_no_rows(spark, tmp_path, small):
    folder = str(tmp_path)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a text", "en", "s", 6), (3, "word " * 9000, "en", "s", 45000)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert 1 <= out.count() <= 4
    spark.createDataFrame([], DOCUMENTS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_near_duplicates_collect_no_keys_on_the_driver(spark, medium, monkeypatch):
    plans = {}

    def kept(rows, name):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        return staged(rows, name)

    monkeypatch.setattr(simhash, "staged", kept)
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    corpus_pipeline.one_of_each_group(spark, docs, medium)
    assert not [name for name in ("members", "rest", "still", "kept") if "Broadcast" in plans[name]]
