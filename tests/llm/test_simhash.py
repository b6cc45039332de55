import re

import numpy as np
import xxhash

from feedmill.llm import components as components_of
from feedmill.llm import queries, simhash
from feedmill.llm.components import components
from feedmill.session import staged


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(marks):
    """Smallest member of each fingerprint's component."""
    marks = np.unique(np.array(marks, np.uint64))
    left, out = set(range(len(marks))), {}
    while left:
        todo, seen = [left.pop()], []
        while todo:
            i = todo.pop()
            seen.append(i)
            for j in [j for j in np.flatnonzero(np.bitwise_count(marks ^ marks[i]) <= 4).tolist() if j in left]:
                left.remove(j)
                todo.append(j)
        for i in seen:
            out[int(marks[i])] = min(int(marks[j]) for j in seen)
    return out


def test_golay_decodes_every_error_of_weight_three():
    golay, r = simhash.Golay(), np.random.default_rng(1)
    assert len(set(golay.error.tolist())) == 2048 and np.bitwise_count(golay.error).max() == 3
    code = [w for w in range(0, 1 << 23, 977) if golay.rest[w] == 0]
    words = np.array(code * 50, np.uint32)
    errors = np.array([sum(1 << b for b in r.choice(23, r.integers(0, 4), False)) for _ in words], np.uint32)
    assert (golay.index(words ^ errors) == words >> np.uint32(11)).all()


def test_linked_fingerprints_share_a_key():
    golay, r = simhash.Golay(), np.random.default_rng(2)
    a = r.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), False)) for _ in a], np.uint64)
    ra, ka = simhash.fuzzy_keys(a, golay)
    rb, kb = simhash.fuzzy_keys(a ^ flips, golay)
    first = set(zip(ra.tolist(), ka.tolist()))
    shared = {i for i, k in zip(rb.tolist(), kb.tolist()) if (i, k) in first}
    assert shared == set(range(len(a)))
    assert np.bincount(ra).max() <= 108


def test_words_in_pieces():
    data = ("Ab \t c\x0bd É\x85x  " * 400).encode()
    whole = np.concatenate(list(simhash.shingle_hashes(data)))
    parts = np.concatenate(list(simhash.shingle_hashes(data, limit=7)))
    assert (whole == parts).all() and simhash.fingerprint(data) == plain(data.decode())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 60), (7, 7), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and got[50] == got[60] == got[100] != got[0] and got[200] == 200
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_against_brute_force_with_and_without_the_second_way(spark):
    r = np.random.default_rng(3)
    centres = r.integers(0, 2**63, 12, dtype=np.uint64) * np.uint64(2)
    dense = [int(c) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 9), False)) for c in centres for _ in range(60)]
    narrow = [int(centres[0]) ^ sum(1 << int(b) for b in r.choice(16, r.integers(0, 12), False)) for _ in range(300)]
    marks = np.unique(np.array(dense + narrow + r.integers(0, 2**63, 300).tolist(), np.uint64))
    want = brute(marks)
    df = spark.createDataFrame([(int(m),) for m in marks.view(np.int64)], "fp long")
    for checks in (simhash.MOST_CHECKS, 0):
        got = {r.fp % 2**64: r.label for r in simhash.groups(df, checks).collect()}
        assert set(got) == set(want)
        pairs = {}
        for fp, label in got.items():
            assert pairs.setdefault(label, want[fp]) == want[fp]
        assert len(pairs) == len(set(want.values()))


BASE = " ".join(f"word{i}" for i in range(400))
ROWS = [
    (5, BASE), (3, BASE), (3, BASE), (9, BASE.upper()), (12, BASE + " tail"), (None, BASE), (20, None), (21, ""), (22, " \n"),
    (30, "short"), (31, "SHORT"), (None, "alone in here with null id"), (40, "other " * 3000), (41, "quite different words in here"), (3, "quite another text"),
]


def test_rows(spark):
    df = spark.createDataFrame([(*x, "c") for x in ROWS], "doc_id long, text string, label string").repartition(3)
    out = simhash.membership(df).collect()
    marks = {t: plain(t) for _, t in ROWS}
    label = brute(list(marks.values()))
    smallest = {}
    for d, t in ROWS:
        if d is not None:
            smallest[label[marks[t]]] = min(d, smallest.get(label[marks[t]], 10**9))
    got = sorted((str(r.doc_id), r.fingerprint % 2**64, r.component_id) for r in out)
    assert got == sorted((str(d), marks[t], smallest.get(label[marks[t]])) for d, t in ROWS)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(label[m] for m in marks.values()))
    assert simhash.membership(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_query(spark, medium):
    out = queries.QUERIES["op8_simhash"].run(spark, medium).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    marks = {d: simhash.fingerprint(t.encode()) for d, t in texts.items()}
    assert all(marks[d] == plain(texts[d]) for d in list(texts)[:60])
    label = brute(list(marks.values()))
    smallest = {}
    for d, m in marks.items():
        smallest[label[m]] = min(d, smallest.get(label[m], 10**9))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in out} == {(d, f"{m:016x}", smallest[label[m]]) for d, m in marks.items()}


def test_keep_one_drops_repeats_and_keeps_clashing_columns(spark):
    rows = [(1, "one two three four five six", "x"), (1, "one two three four five six", "x"), (2, "one two three four five six", "y"), (3, "other words stand here alone now", "z"), (None, None, "n"), (None, None, "n")]
    names = "doc_id long, text string, _key string"
    df = spark.createDataFrame(rows, names).withColumn("_kept", simhash.F.lit(1)).withColumn("label", simhash.F.lit("l")).withColumn("_doc", simhash.F.lit(2))
    out = simhash.keep_one(df.repartition(3))
    assert out.columns == ["doc_id", "text", "_key", "_kept", "label", "_doc"]
    assert sorted((str(r.doc_id), r["_key"], r["_kept"], r.label, r["_doc"]) for r in out.collect()) == [("1", "x", 1, "l", 2), ("3", "z", 1, "l", 2), ("None", "n", 1, "l", 2)]


def test_keys_and_links_are_not_collected_on_the_driver(spark, monkeypatch):
    """A broadcast passes through the driver, and the keys of a task look as small to Spark as their fingerprints."""
    plans = []

    def kept(rows, name):
        plans.append((name, rows._jdf.queryExecution().executedPlan().toString()))
        return staged(rows, name)

    monkeypatch.setattr(simhash, "staged", kept)
    monkeypatch.setattr(components_of, "staged", kept)
    marks = [(int(m),) for m in np.random.default_rng(4).integers(-(2**62), 2**62, 50)]
    marks += [(m ^ 1,) for (m,) in marks[:20]]
    found = simhash.groups(staged(spark.createDataFrame(marks, "fp long"), "marks"))  # Spark knows the size of files
    assert found.count() == 70 and len({r.label for r in found.collect()}) == 50
    assert {"members", "rest", "still", "edges"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if name != "labels" and "Broadcast" in plan]
