"""Connected components of an undirected graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.session import staged


def _parents(edges: DataFrame) -> DataFrame:
    """Each node with the smallest of itself and its neighbours; a combined minimum, so hubs do not gather."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select("v", "u"))
    return both.groupBy("node").agg(F.min("other").alias("_least")).select("node", F.least("node", "_least").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (u, v); nodes have one label exactly if a path joins them.

    Every round maps the nodes to their smallest neighbour and keeps only edges between different
    labels, so with labels in random order the graph shrinks by a constant factor each time.  What a round
    makes is written to the shared folder, which keeps the lineage short.  Edges meet their ends by sort-merge joins,
    so neither passes through the driver.  Self-loops are allowed; an empty graph has no labels.
    """
    edges = staged(edges.select("u", "v"), "edges")
    labels = parents = staged(_parents(edges), "labels")
    while True:
        ends = edges.join(parents.select(F.col("node").alias("u"), F.col("label").alias("lu")).hint("merge"), "u")
        ends = ends.join(parents.select(F.col("node").alias("v"), F.col("label").alias("lv")).hint("merge"), "v")
        ends = ends.filter("lu != lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()
        edges = staged(ends, "edges")
        if edges.isEmpty():
            return labels
        parents = staged(_parents(edges), "labels")
        step = parents.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        labels = staged(
            labels.join(step, "label", "left").select("node", F.coalesce("_next", "label").alias("label")), "labels"
        )
