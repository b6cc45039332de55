import math

import numpy as np

from feedmill.llm import topk
from feedmill.llm.queries import QUERIES
from tests.oracle import compare, connect


def brute(rows, k=5, every=50):
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in good:
        if i % every == 0:
            own = sorted({(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in good if j != i and len(v) == len(q)})[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(own, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "r") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(3)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, **kw).collect())


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).round(2).tolist()) for i in range(700)]
    rows += [(i, [0.5] * 6) for i in range(700, 1100)]  # one vector held by a third of all rows
    rows += [(0, rows[0][1]), (50, rows[50][1]), (2001, None), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [math.nan] * 6), (2050, [math.inf] * 6), (None, [1.0] * 6), (2100, [9.0, 9.0]), (2101, [3.0, 1.0]), (2150, [])]
    want = brute(rows)
    assert run(spark, rows, shard=60, leaf=8) == want
    assert run(spark, rows) == want
    assert run(spark, rows[:1]) == [] and run(spark, [(1, [1.0]), (50, [2.0])]) == [(50, 1, 1, 131072)]


def test_large_components_and_empty(spark):
    rows = [(i, [float(i) * 1e9, -3.25e12, 1e30 if i == 7 else 0.0]) for i in range(0, 120)]
    assert run(spark, rows, shard=20, leaf=4) == brute(rows)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tree_prunes():
    r = np.random.default_rng(2)
    rows = np.concatenate([r.normal(size=(500, 8)) * 3 + c for c in r.normal(size=(12, 8)) * 200]).round()
    tree, visited = topk.BallTree(np.arange(len(rows)), rows, 64), []
    original = topk.products
    topk.products = lambda q, x: visited.append(len(q) * len(x)) or original(q, x)
    try:
        at, found, scores = topk.search(tree, np.array([-1]), rows[:1], np.array([-(2**63)]), 5)
    finally:
        topk.products = original
    assert sum(visited) < len(rows) / 4
    assert scores.tolist() == sorted((rows @ rows[0]).astype(int).tolist(), reverse=True)[:5]


def test_query_equals_sql(spark, small, medium):
    for sf in (small, medium):
        assert compare(QUERIES["op10_topk"].run(spark, sf), connect(sf), QUERIES["op10_topk"].sql) == []
