"""What the physical plans and the source text must not contain, whatever the data size."""

import pathlib
import re

import pytest

from feedmill.plans import catalog

PACKAGE = pathlib.Path(__file__).parent.parent / "feedmill"
LIGHT = [
    n for n in sorted(catalog.load())
    if not n.startswith(("stream_", "knn_cells", "ingest_", "origin_totals", "text_search", "knn_by_label"))
]


@pytest.mark.parametrize("name", LIGHT)
def test_no_cross_joins_and_no_unpartitioned_windows(spark, small, name):
    plan = catalog.QUERIES[name].run(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for window in re.findall(r"(?:Window|WindowGroupLimit) \[.*", plan):
        assert "SinglePartition" not in window
    assert not re.search(r"Exchange SinglePartition[^\n]*\n[^\n]*Window", plan)


def test_source_holds_no_hints_and_no_driver_side_shortcuts():
    for path in PACKAGE.rglob("*.py"):
        text = path.read_text()
        for word in ("broadcast(", "crossJoin", "localCheckpoint", ".rdd", "toPandas", "tempfile.gettempdir"):
            if word != "broadcast(" or path.parent.name != "llm":  # there a fixed or measured bound goes with it
                assert word not in text, f"{word} in {path}"


def test_wide_text_is_not_ranked(spark, small):
    from feedmill.operators.ranking import newest_first, top_keys
    from feedmill.plans import views

    articles = views.view(spark, small, "articles")
    scan = top_keys(articles, "source_id", 5, newest_first())._jdf.queryExecution().executedPlan().toString()
    assert "text" not in scan[scan.index("ReadSchema"):]


def test_the_window_is_broadcast_and_summaries_are_not_shuffled(spark, small):
    from feedmill.plans import digests, views

    articles, summaries, sources = (views.view(spark, small, n) for n in ("articles", "article_summaries", "sources"))
    flat = summaries.select("id", "article_id", "model", "summary", "key_points")
    plan = digests.digest(articles, flat, sources, views.AS_OF, 168)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
