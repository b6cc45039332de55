import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F

from feedmill.operators import scoring, search as knn
from feedmill.plans import search as plans


def table(spark, vectors, parts=4):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "article_id long, embedding array<float>").repartition(parts)


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(500, 16)).astype("float32")
    query = rng.normal(size=16)
    similarity = (vectors @ query) / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(query))
    want = sorted(range(500), key=lambda i: (-similarity[i], i))[:10]
    got = knn.nearest_to(table(spark, vectors, 7), query, 10).orderBy("position").collect()
    assert [r.article_id for r in got] == want
    assert np.allclose([r.similarity for r in got], similarity[want], atol=1e-6)
    queries = {int(q): rng.normal(size=16) for q in range(20)}
    batch = knn.nearest(table(spark, vectors, 3), queries, 3).collect()
    for q, v in queries.items():
        s = (vectors @ v) / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(v))
        assert [r.article_id for r in sorted(batch, key=lambda r: r.position) if r.query_id == q] == sorted(range(500), key=lambda i: (-s[i], i))[:3]


def test_vectors_without_a_direction_are_left_out_and_ties_go_to_the_lower_id(spark):
    vectors = [[0, 0], None, [1, 0, 0], [2, 0], [1, 0], [0, 1], [3, 0]]
    got = knn.nearest_to(table(spark, vectors), [1, 0], 4).orderBy("position").collect()
    assert [r.article_id for r in got] == [3, 4, 6, 5]


def test_many_equal_scores_keep_the_lowest_ids(spark):
    got = knn.nearest_to(table(spark, [[1, 1]] * 1000, 5), [1, 1], 5).orderBy("position").collect()
    assert [r.article_id for r in got] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("queries", [{}, {0: [0.0, 0.0]}, {0: [1.0], 1: [1.0, 2.0]}])
def test_bad_queries_are_refused(spark, queries):
    with pytest.raises(ValueError):
        knn.nearest(table(spark, [[1, 1]]), queries, 1)


def test_argument_contract():
    knn.check_arguments("ab", 50)
    for query, limit in (("a", 10), ("ab", 0), ("ab", 51)):
        with pytest.raises(ValueError):
            knn.check_arguments(query, limit)


def test_cell_index_recall_and_pruning(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24)) * 3
    vectors = np.concatenate([c + rng.normal(size=(100, 24)) for c in centres]).astype("float32")
    vectors[7] = 0
    rows = table(spark, vectors)
    index = knn.CellIndex.build(rows, str(tmp_path / "cells"), cells=12)
    assert index.table().count() == len(vectors) - 1
    hits = 0
    for q in range(5):
        query = vectors[q * 200 + 11]
        exact = {r.article_id for r in knn.nearest_to(rows, query, 10).collect()}
        hits += len(exact & {r.article_id for r in index.search(query, 10, probes=4).collect()})
        assert exact == {r.article_id for r in index.search(query, 10, probes=12).collect()}
    assert hits / 50 >= 0.9
    plan = index.search(vectors[0], 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_a_third_of_all_vectors_in_one_cell(spark, tmp_path):
    vectors = np.concatenate([np.tile([1.0, 0.0], (300, 1)), np.random.default_rng(1).normal(size=(600, 2))])
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    index = knn.CellIndex.build(table(spark, vectors), str(tmp_path / "hot"), cells=6)
    assert index.table().count() == 900
    files = index.table().withColumn("file", F.input_file_name())
    sizes = files.groupBy("cell").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).collect()
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert max(sizes, key=lambda r: r.n).files > 1


def test_text_search_finds_the_matching_article(spark):
    articles = spark.sql("""select * from values
      (1L, 1L, 'A', 'u1', cast(null as timestamp_ntz), 'solar wind turbines'), (2L, 1L, 'B', 'u2', null, 'stock market news'),
      (3L, 2L, 'C', 'u3', null, 'solar panels and wind'), (4L, 9L, 'gone', 'u4', null, 'solar wind turbines')
      t(id, source_id, title, url, published_at, content)""")
    sources = spark.sql("select * from values (1L, 'one'), (2L, 'two') t(id, name)")
    summaries = spark.sql("select * from values (5L, 1L, 's5', array('p')), (6L, 1L, 's6', array('q')) t(id, article_id, summary, key_points)")
    vectors = scoring.embed(articles, "content")
    found = plans.search_text("solar wind turbines", vectors, articles, sources, summaries, limit=3).collect()
    assert [(r.id, r.summary) for r in found] == [(1, "s5"), (1, "s6"), (3, None)]
    single = plans.search_text("solar wind turbines", vectors, articles, sources, summaries, limit=2, per_article=True).collect()
    assert [(r.id, r.summary) for r in single] == [(1, "s5"), (3, None)]
    assert found[0].similarity == pytest.approx(1.0, abs=1e-6)


def test_centres_and_model_summary(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 3.0], "m"), (2, 0, [3.0, 5.0], "m"), (3, 1, [0.0, 1.0], "n")], "article_id long, label int, embedding array<float>, model string")
    assert {r.query_id: r.vector for r in knn.group_centres(rows, "label").collect()} == {0: [2.0, 4.0], 1: [0.0, 1.0]}
    got = {r.model: (r.n_vectors, r.min_dim, r.max_dim, r.wrong_dim) for r in knn.model_summary(rows, 2).collect()}
    assert got == {"m": (2, 2, 2, 0), "n": (1, 2, 2, 0)}


def test_many_queries_are_worked_off_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i), float(7 - i)]) for i in range(8)], "article_id long, embedding array<float>")
    queries = {i: [float(i + 1), 3.0] for i in range(9)}
    whole, parts = (
        sorted((r.query_id, r.position, r.article_id, round(r.similarity, 9)) for r in knn.nearest(rows, queries, 3, query_floats=n).collect())
        for n in (knn.QUERY_FLOATS, 4)
    )
    assert len(whole) == 27 and parts == whole


def test_similarities_equal_the_ranking(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0])], "article_id long, embedding array<float>")
    got = {r.article_id: round(r.similarity, 6) for r in knn.similarities(rows, [2.0, 0.0]).collect()}
    assert got == {1: 1.0, 4: 0.707107}


def clustered(n, dimension, seed, around=8):
    """Vectors near a few directions, as embeddings of texts are."""
    r = np.random.default_rng(seed)
    middles = r.normal(size=(around, dimension))
    return (middles[r.integers(0, around, n)] + 0.25 * r.normal(size=(n, dimension))).astype("float32")


def frame(spark, vectors, name="embedding", key="article_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"{key} long, {name} array<float>")


def brute(queries, rows, k):
    unit = lambda m: m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    scores = unit(queries) @ unit(rows).T
    return {(q, p + 1): int(i) for q, own in enumerate(scores) for p, i in enumerate(np.lexsort((np.arange(len(own)), -own.round(12)))[:k])}


def test_a_table_of_queries_finds_what_comparing_everything_finds(spark, tmp_path):
    rows, asked = clustered(1500, 12, 1), clustered(60, 12, 2)
    asked[5] = rows[7]
    index = knn.CellIndex.build(frame(spark, rows), str(tmp_path / "cells"), cells=10)
    want = brute(asked, rows, 6)
    queries = frame(spark, asked, "vector", "query_id")
    for options in ({}, {"part_rows": 40, "block_queries": 9}):  # cells and queries in one piece, and cut
        found = index.search_many(queries, 6, probes=2, **options).collect()
        assert {(r.query_id, r.position): r.article_id for r in found} == want and len(found) == 360
    near = index.search_many(queries, 6, probes=2, exact=False).collect()
    assert len({(r.query_id, r.article_id) for r in near} & {(q, i) for (q, _), i in want.items()}) >= 0.9 * 360


def test_the_bound_leaves_far_cells_out(spark, tmp_path):
    rows = clustered(1500, 12, 3)
    index = knn.CellIndex.build(frame(spark, rows), str(tmp_path / "cells"), cells=8)
    sizes, least = index.reach()
    assert sizes.sum() == 1500
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([rows[0].astype("float64").tolist()]), pa.array([0.95])], names=["query_id", "vector", "kth"])
    rest = next(knn._cells(index.units(), sizes, least, 1, "rest")([batch])).column(2).to_pylist()
    assert len(rest) < 7
    near = set(index.table().filter(~F.col("cell").isin(rest)).select("article_id").toPandas()["article_id"])
    unit = rows.astype("float64") / np.linalg.norm(rows.astype("float64"), axis=1, keepdims=True)
    assert {int(i) for i in np.flatnonzero(unit @ unit[0] >= 0.95)} <= near


def test_odd_queries_ties_and_empty_tables(spark, tmp_path):
    rows = frame(spark, np.array([[1, 0], [1, 0], [0, 1], [0, 0], [-1, 0]], "float32"))
    index = knn.CellIndex.build(rows, str(tmp_path / "cells"), cells=2)
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 2.0, 3.0]), (5, [float("nan"), 1.0])], "query_id long, vector array<double>")
    found = index.search_many(queries, 3, probes=1).collect()
    assert [(r.query_id, r.position, r.article_id) for r in sorted(found, key=lambda r: r.position)] == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert index.search_many(queries.limit(0), 3, probes=1).count() == 0
    with pytest.raises(ValueError):
        index.search_many(queries, 0, probes=1)


def test_five_thousand_groups(spark, tmp_path):
    vectors = clustered(10000, 6, 4)
    labelled = frame(spark, vectors).withColumn("label", (F.col("article_id") % 5000).cast("int"))
    index = knn.CellIndex.build(labelled, str(tmp_path / "cells"), cells=12)
    found = {(r.query_id, r.position): r.article_id for r in index.search_many(knn.group_centres(labelled, "label"), 2, probes=2, block_queries=2000).collect()}
    centres = (vectors[:5000].astype("float64") + vectors[5000:].astype("float64")) / 2
    assert len(found) == 10000 and found == brute(centres, vectors, 2)


def test_request_contract_agrees_with_the_argument_check(spark):
    asked = [(None, 5), ("a", 5), ("ab", 0), ("ab", 1), ("ab", 50), ("ab", 51), ("ab", None)]
    got = spark.createDataFrame(asked, "q string, n int").select(knn.accepted_arguments(F.col("q"), F.col("n"))).collect()
    assert [r[0] for r in got] == [False, False, False, True, True, False, False]
    for (q, n), accepted in zip(asked[1:-1], got[1:-1]):
        try:
            knn.check_arguments(q, n)
            assert accepted[0]
        except ValueError:
            assert not accepted[0]
