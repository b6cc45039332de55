"""Vector search over whole embedding tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from feedmill.functions import vectors
from feedmill.operators import search as knn
from feedmill.plans import search
from feedmill.plans.catalog import query
from feedmill.session import scratch_path

# One query direction, given as a search argument.
QUERY = [round(math.sin(i + 1), 4) for i in range(64)]
_Q = "[" + ", ".join(str(v) for v in QUERY) + "]::double[]"
_SIM = f"list_cosine_similarity(embedding::double[], {_Q})"


@query(
    "knn_exact", "V1 K7 J10",
    f"""select article_id, cast(row_number() over (order by s desc, article_id) as int) as position, round(s, 6) as similarity
    from (select article_id, {_SIM} as s from article_embeddings) e order by s desc, article_id limit 10""",
    "article_embeddings",
)
def knn_exact(t):
    best = knn.nearest_to(t.article_embeddings, QUERY, 10)
    return best.select("article_id", "position", F.round("similarity", 6).alias("similarity"))


@query(
    "knn_by_label", "V3 J10",
    """select query_id, article_id, position from (
      select q.label as query_id, e.article_id,
        cast(row_number() over (partition by q.label order by list_cosine_similarity(e.embedding::double[], q.centre) desc, e.article_id) as int) as position
      from article_embeddings e cross join (
        select label::bigint as label, list(m order by i) as centre from (
          select label, i, avg(v::double) as m from (
            select label, unnest(embedding) as v, unnest(range(len(embedding))) as i from article_embeddings) u
          group by label, i) g group by label) q) r where position <= 5""",
    "article_embeddings",
)
def knn_by_label(t):
    """Any number of groups: their centres stay a table and meet the cells of the index by a join."""
    index = knn.CellIndex.build(t.article_embeddings, scratch_path(t.spark, "cells"), cells=16)
    return index.search_many(knn.group_centres(t.article_embeddings, "label"), 5, probes=2).select("query_id", "article_id", "position")


@query(
    "pairwise_similarity", "V2",
    """select a.article_id, b.article_id as other_id,
      round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity
    from article_embeddings a join article_embeddings b on b.article_id = a.article_id + 1""",
    "article_embeddings",
)
def pairwise_similarity(t):
    one = t.article_embeddings.select("article_id", "embedding")
    other = one.select(
        F.col("article_id").alias("other_id"), F.col("embedding").alias("other"), (F.col("article_id") - 1).alias("article_id")
    )
    return one.join(other, "article_id").select(
        "article_id", "other_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity")
    )


@query(
    "knn_cells", "V4",
    f"""select article_id, cast(row_number() over (order by s desc, article_id) as int) as position, round(s, 6) as similarity
    from (select article_id, {_SIM} as s from article_embeddings) e order by s desc, article_id limit 10""",
    "article_embeddings",
)
def knn_cells(t):
    """The cell index with every cell probed must equal the exact search."""
    index = knn.CellIndex.build(t.article_embeddings, scratch_path(t.spark, "cells"), cells=16)
    return index.search(QUERY, 10, probes=16).select(
        "article_id", "position", F.round("similarity", 6).alias("similarity")
    )


@query(
    "knn_cells_probed", "V4",
    f"""select article_id, cast(row_number() over (order by s desc, article_id) as int) as position, round(s, 6) as similarity
    from (select article_id, {_SIM} as s from article_embeddings) e order by s desc, article_id limit 10""",
    "article_embeddings",
)
def knn_cells_probed(t):
    """Four cells are probed, and of the others those that the bound does not rule out: exact."""
    index = knn.CellIndex.build(t.article_embeddings, scratch_path(t.spark, "cells"), cells=16)
    one = t.spark.createDataFrame([(0, QUERY)], "query_id long, vector array<double>")
    return index.search_many(one, 10, probes=4).select("article_id", "position", F.round("similarity", 6).alias("similarity"))


@query(
    "knn_cells_recall", "V4",
    """select count(*) as queries, 10 * count(*) as wanted, true as recall_reached from article_embeddings where article_id % 50 = 0""",
    "article_embeddings",
)
def knn_cells_recall(t):
    """Recall of 12 probed cells of 16 against the exact ten, over every vector whose id divides by 50: 0.9 or more.

    These vectors are spread evenly in 64 dimensions, where a neighbour may lie in any cell: 6 cells find 0.7 to 0.8 of them.
    """
    index = knn.CellIndex.build(t.article_embeddings, scratch_path(t.spark, "cells"), cells=16)
    asked = t.article_embeddings.filter("article_id % 50 = 0").select(F.col("article_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = index.search_many(asked, 10, probes=1).select("query_id", "article_id")
    near = index.search_many(asked, 10, probes=12, exact=False).select("query_id", "article_id", F.lit(1).alias("hit"))
    met = exact.join(near, ["query_id", "article_id"], "left")
    return met.agg(
        F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"),
        (F.count("hit") >= F.lit(0.9) * F.count("*")).alias("recall_reached"),
    )


@query(
    "vector_texts", "V5",
    """select article_id, '[' || array_to_string(list_transform(embedding, lambda x: cast(cast(round(x::double * 1000) as int) as varchar)), ',') || ']' as literal
       from article_embeddings""",
    "article_embeddings",
)
def vector_texts(t):
    scaled = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int"))
    return t.article_embeddings.select("article_id", vectors.vector_text(scaled).alias("literal"))


@query(
    "vector_literals", "V5",
    """select article_id, cast(unnest(range(len(embedding))) as int) as place, cast(unnest(embedding) as double) as value from article_embeddings""",
    "article_embeddings",
)
def vector_literals(t):
    """Every number of every vector, read back from the vector's text."""
    read = F.from_json(vectors.vector_text(F.col("embedding")), "array<float>")
    rows = t.article_embeddings.select("article_id", F.posexplode(read).alias("place", "value"))
    return rows.withColumn("value", F.col("value").cast("double"))


@query(
    "model_info", "V6 P16",
    """select model, count(*) as n_vectors, cast(min(len(embedding)) as int) as min_dim, cast(max(len(embedding)) as int) as max_dim,
      count(*) filter (where len(embedding) <> 64) as wrong_dim from article_embeddings group by model""",
    "article_embeddings",
)
def model_info(t):
    return knn.model_summary(t.article_embeddings, 64)


_SEARCH = f"""
select a.id, a.title, a.url, a.published_at, s.name as source_name, m.summary,
  array_to_string(m.key_points, '|') as key_points, round(e.s, 6) as similarity
from (select article_id, {_SIM} as s from article_embeddings) e join articles a on a.id = e.article_id
  join sources s on s.id = a.source_id left join {{summaries}} m on m.article_id = a.id
order by e.s desc, a.id, m.id limit 20"""


def _found(t, per_article):
    rows = search.search(QUERY, t.article_embeddings, t.articles, t.sources, t.article_summaries, 20, per_article)
    return rows.withColumn("key_points", F.array_join("key_points", "|")).withColumn("similarity", F.round("similarity", 6))


@query(
    "semantic_search", "V1 J4 M5", _SEARCH.format(summaries="article_summaries"),
    "articles sources article_summaries article_embeddings",
)
def semantic_search(t):
    return _found(t, per_article=False)


@query(
    "semantic_search_per_article", "V1 W6 M5",
    _SEARCH.format(summaries="(select * from article_summaries where id in (select min(id) from article_summaries group by article_id))"),
    "articles sources article_summaries article_embeddings",
)
def semantic_search_per_article(t):
    return _found(t, per_article=True)


@query("text_search", "M5 F3 P19")
def text_search(t):
    from feedmill.operators.scoring import embed

    articles = t.articles
    embedded = embed(articles, "content")
    return search.search_text(
        "the ered thentied", embedded, articles, t.sources, t.article_summaries, 10
    ).withColumn("key_points", F.array_join("key_points", "|"))
