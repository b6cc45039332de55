"""Exact and bucketed nearest-neighbour search over ``array<float>`` embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from feedmill import fixed_values as fv
from feedmill.session import staged

#: Numbers of query vectors that travel in one task closure; more queries are worked off in blocks.
QUERY_FLOATS = 1 << 20
#: Rows of a cell, and queries, that one task multiplies with one another.
PART_ROWS = 1 << 16
BLOCK_QUERIES = 1 << 13


def check_arguments(query_text: str, limit: int) -> None:
    """Argument contract of the text search [P19]."""
    if len(query_text) < fv.SEARCH_MIN_QUERY_CHARS:
        raise ValueError(f"query needs at least {fv.SEARCH_MIN_QUERY_CHARS} characters")
    check_limit(limit)


def accepted_arguments(query_text: Column, limit: Column) -> Column:
    """The contract of :func:`check_arguments` for a table of requests; NULL arguments are refused [P19]."""
    long_enough = F.length(query_text) >= fv.SEARCH_MIN_QUERY_CHARS
    return F.coalesce(long_enough & limit.between(fv.SEARCH_MIN_LIMIT, fv.SEARCH_MAX_LIMIT), F.lit(False))


def check_limit(limit: int) -> None:
    """Allowed number of search results [P19]."""
    if not fv.SEARCH_MIN_LIMIT <= limit <= fv.SEARCH_MAX_LIMIT:
        raise ValueError(f"limit must be between {fv.SEARCH_MIN_LIMIT} and {fv.SEARCH_MAX_LIMIT}")


def _query_matrix(queries: Mapping[int, Sequence[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit rows of the queries."""
    if not queries:
        raise ValueError("give at least one query vector")
    matrix = np.array([list(v) for v in queries.values()], dtype="float64")
    if matrix.ndim != 2 or not matrix.shape[1]:
        raise ValueError("query vectors must share one dimension")
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    if (lengths == 0).any():
        raise ValueError("a query vector of length zero has no direction")
    return np.array(list(queries), dtype="int64"), matrix / lengths


def nearest(
    candidates: DataFrame,
    queries: Mapping[int, Sequence[float]],
    k: int,
    key: str = "article_id",
    vector: str = "embedding",
    query_floats: int = QUERY_FLOATS,
) -> DataFrame:
    """(query_id, key, similarity, position) of the ``k`` most similar candidates per query [V1, V3].

    Every task scores its batches by one matrix product and hands on at most ``k`` rows per query
    (a map-side combined top-k); the final ranking sees tasks x k rows per query.  NULL vectors,
    other dimensions and zero vectors have no similarity and are left out; ties go to the lower key.
    Queries of more than ``query_floats`` numbers are searched in blocks, one scan for each.
    """
    if k < 1:
        raise ValueError("k must be positive")
    ids, matrix = _query_matrix(queries)
    block = max(1, query_floats // matrix.shape[1])
    parts = [_nearest(candidates, ids[at : at + block], matrix[at : at + block], k, key, vector) for at in range(0, len(ids), block)]
    return reduce(DataFrame.unionByName, parts)


def _usable(candidates: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    return candidates.filter(F.size(vector) == dimension).select(
        F.col(key).cast("long").alias("candidate"), F.col(vector).cast("array<float>").alias("vector")
    )


def _directions(batch: pa.RecordBatch, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit rows of the vectors with a direction."""
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(keys), dimension)
    lengths = np.linalg.norm(rows, axis=1)
    real = lengths > 0
    return keys[real], rows[real] / lengths[real, None]


def similarities(candidates: DataFrame, query: Sequence[float], key: str = "article_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of every candidate with a direction: scored in the scan, so vectors are never shuffled [V1]."""
    _, matrix = _query_matrix({0: query})
    unit, dimension = matrix[0], matrix.shape[1]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = _directions(batch, dimension)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows @ unit)], names=["candidate", "similarity"])

    found = _usable(candidates, key, vector, dimension).mapInArrow(scored, "candidate long, similarity double")
    return found.withColumnRenamed("candidate", key)


def _nearest(candidates: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, key: str, vector: str) -> DataFrame:
    dimension = matrix.shape[1]
    scored_type = "query_id long, candidate long, similarity double"

    def best(keys: np.ndarray, scores: np.ndarray) -> np.ndarray:
        if len(keys) > 4 * k:
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
            likely = np.flatnonzero(scores >= floor)
            return likely[np.lexsort((keys[likely], -scores[likely]))[:k]]
        return np.lexsort((keys, -scores))[:k]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0, "int64"), np.empty(0, "float64")) for _ in ids]
        for batch in batches:
            keys, rows = _directions(batch, dimension)
            scores = rows @ matrix.T
            for i in range(len(ids)):
                both_keys = np.concatenate([kept[i][0], keys])
                both = np.concatenate([kept[i][1], scores[:, i]])
                order = best(both_keys, both)
                kept[i] = (both_keys[order], both[order])
        for query_id, (keys, scores) in zip(ids, kept):
            if len(keys):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), query_id)), pa.array(keys), pa.array(scores)],
                    names=["query_id", "candidate", "similarity"],
                )

    partials = _usable(candidates, key, vector, dimension).mapInArrow(partial, scored_type)
    ranked = partials.withColumn(
        "position",
        F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "candidate")),
    )
    return ranked.filter(F.col("position") <= k).withColumnRenamed("candidate", key)


def nearest_to(
    candidates: DataFrame, query: Sequence[float], k: int, key: str = "article_id", vector: str = "embedding"
) -> DataFrame:
    """(key, similarity, position) of the ``k`` candidates most similar to one vector [V1, K7]."""
    return nearest(candidates, {0: query}, k, key, vector).drop("query_id")


def group_centres(embeddings: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(query_id, vector): the mean vector of every group, for searching around it; any number of groups."""
    from pyspark.ml.stat import Summarizer

    means = (
        embeddings.select(F.col(group).cast("long").alias("query_id"), array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
        .groupBy("query_id")
        .agg(Summarizer.mean(F.col("_v")).alias("_centre"))
    )
    return means.select("query_id", vector_to_array("_centre").alias("vector"))


def model_summary(embeddings: DataFrame, expected_dim: int = fv.EMBEDDING_DIM) -> DataFrame:
    """Vectors, smallest and largest dimension and mismatches per model [V6, P16]."""
    size = F.size("embedding")
    return embeddings.groupBy("model").agg(
        F.count("*").alias("n_vectors"),
        F.min(size).alias("min_dim"),
        F.max(size).alias("max_dim"),
        F.count_if(size != expected_dim).alias("wrong_dim"),
    )


def _unit_rows(column: pa.Array, dimension: int) -> np.ndarray:
    """Unit rows of vectors of one dimension."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dimension)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query over all parts."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "article_id"))
    return rows.withColumn("position", place).filter(F.col("position") <= k).select("query_id", "article_id", "similarity", "position")


def _cells(units: np.ndarray, sizes: np.ndarray, least: np.ndarray, probes: int, which: str):
    """For each query the cells it meets: its nearest ones first, then of the rest those that may hold a better row.

    The angle from a query to any row of a cell is at least its angle to the centre less the cell's widest angle.
    """
    used = np.flatnonzero(sizes)
    widest = np.arccos(np.clip(least[used], -1.0, 1.0))
    slack = 1e-7  # rounding of angles; too wide costs time, not results

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells, vectors = [], [], []
            for query_id, vector, kth in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                own = np.array(vector or [], "float64")
                length = float(np.linalg.norm(own)) if own.shape == units.shape[1:] else 0.0
                if not length > 0 or not np.isfinite(length):
                    continue
                angle = np.arccos(np.clip(units[used] @ (own / length), -1.0, 1.0))
                order = np.argsort(angle, kind="stable")
                chosen = order[:probes]
                if which == "rest":
                    chosen = order[probes:]
                    if kth is not None:
                        bound = np.arccos(np.clip(kth, -1.0, 1.0)) + slack
                        chosen = chosen[angle[chosen] - widest[chosen] <= bound]
                ids += [query_id] * len(chosen)
                cells += used[chosen].tolist()
                vectors += [vector] * len(chosen)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float64())), pa.array(cells, pa.int32())], names=["query_id", "vector", "cell"])

    return run


class CellIndex:
    """A coarse inverted-file index: vectors grouped into k-means cells on the unit sphere [V4].

    The table on disk is partitioned by cell, so a search reads only the probed cells.  Rows are
    rebalanced when written: small cells are one file, a cell with very many vectors is split over
    tasks and files of about the advisory size.
    """

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray):
        self.spark, self.path, self.centres = spark, path, centres

    @classmethod
    def build(
        cls,
        embeddings: DataFrame,
        path: str,
        cells: int,
        key: str = "article_id",
        vector: str = "embedding",
        seed: int = 7,
        iterations: int = 10,
        training_per_cell: int = 256,
    ) -> "CellIndex":
        """Fit the cells, assign every vector with a direction and write the partitioned table.

        The centres are fitted on a sample of ``training_per_cell`` vectors per cell (all, if
        fewer), chosen by a hash of the key, since every iteration passes over them; all vectors
        are then assigned in a single pass.
        """
        spark = embeddings.sparkSession
        usable = embeddings.select(
            F.col(key).cast("long").alias("article_id"), F.col(vector).cast("array<float>").alias("embedding")
        ).filter(F.exists("embedding", lambda x: x != 0))
        featured = usable.withColumn("_features", array_to_vector(F.col("embedding").cast("array<double>")))
        sample = usable.orderBy(F.xxhash64("article_id"), "article_id").limit(cells * training_per_cell)
        training = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("_features")).persist()
        try:
            model: KMeansModel = KMeans(
                k=cells, seed=seed, maxIter=iterations, distanceMeasure="cosine",
                featuresCol="_features", predictionCol="cell",
            ).fit(training)
        finally:
            training.unpersist()
        assigned = model.transform(featured).select("article_id", "embedding", "cell")
        assigned.hint("rebalance", "cell").write.mode("errorifexists").partitionBy("cell").parquet(path)
        return cls(spark, path, np.array(model.clusterCenters()))

    def probed_cells(self, query: Sequence[float], probes: int) -> list[int]:
        """The cells whose centres are most similar to the query."""
        q = np.asarray(query, dtype="float64")
        lengths = np.linalg.norm(self.centres, axis=1)
        similarity = (self.centres @ q) / np.where(lengths == 0, 1.0, lengths)
        return [int(c) for c in np.argsort(-similarity, kind="stable")[:probes]]

    def units(self) -> np.ndarray:
        """Unit rows of the centres; a centre without direction is a row of zeros."""
        lengths = np.linalg.norm(self.centres, axis=1, keepdims=True)
        return self.centres / np.where(lengths == 0, 1.0, lengths)

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows, least similarity to the centre) of every cell: one pass over the table, a row per task and cell."""
        units, schema = self.units(), "cell int, n long, least double"

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, least = np.zeros(len(units), np.int64), np.ones(len(units))
            for batch in batches:
                rows = _unit_rows(batch.column(0), units.shape[1])
                cell = batch.column(1).to_numpy()
                n += np.bincount(cell, minlength=len(units))
                np.minimum.at(least, cell, np.einsum("ij,ij->i", rows, units[cell]))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(least[used])], names=["cell", "n", "least"])

        found = self.table().select("embedding", "cell").mapInArrow(measured, schema)
        rows, least = np.zeros(len(units), np.int64), np.ones(len(units))
        for r in found.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least")).collect():  # a row per cell
            rows[r.cell], least[r.cell] = r.n, r.least
        return rows, least

    def search_many(
        self, queries: DataFrame, k: int, probes: int, exact: bool = True, part_rows: int = PART_ROWS, block_queries: int = BLOCK_QUERIES
    ) -> DataFrame:
        """(query_id, article_id, similarity, position) of the ``k`` most similar rows for each row (query_id, vector) of a table.

        Queries meet the rows of their ``probes`` nearest cells by a join on the cell.  With ``exact`` they then meet those other
        cells that may still hold a better row: all rows of a cell lie within an angle of its centre, so a cell
        further off than that and the angle of the k-th row found cannot.  Without it the result is approximate.

        Cells of more than ``part_rows`` rows and more than ``block_queries`` queries are cut into parts and blocks by hash,
        so neither a hot cell nor many queries gather in one task; each (query, part) hands on k rows at most.  Queries
        without direction, or of another dimension, have no rows.
        """
        if k < 1 or probes < 1:
            raise ValueError("k and probes must be positive")
        units, (sizes, least) = self.units(), self.reach()
        parts = [max(1, -(-int(n) // part_rows)) for n in sizes]
        asked = staged(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")), "queries")
        blocks = max(1, -(-asked.count() // block_queries))
        first = self._meet(asked.withColumn("kth", F.lit(None).cast("double")), _cells(units, sizes, least, probes, "first"), k, parts, blocks)
        if not exact:
            return _best(first, k)
        first = staged(_best(first, k), "first")
        kth = first.filter(F.col("position") == k).select("query_id", F.col("similarity").alias("kth"))
        rest = self._meet(asked.join(kth, "query_id", "left"), _cells(units, sizes, least, probes, "rest"), k, parts, blocks)
        return _best(first.drop("position").unionByName(rest), k)

    def _meet(self, queries: DataFrame, cells, k: int, parts: list[int], blocks: int) -> DataFrame:
        """The k best rows for each query within each part of the cells that ``cells`` names for it."""
        cut = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("cell") + 1)
        named = queries.mapInArrow(cells, "query_id long, vector array<double>, cell int")
        asks = named.select(
            "query_id", "vector", "cell", F.explode(F.sequence(F.lit(0), cut - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
        )
        rows = self.table().withColumn("part", F.pmod(F.xxhash64("article_id"), cut).cast("int"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys, dimension = ["cell", "part", "block"], self.centres.shape[1]

        def product(key, queries, rows):
            names = ["query_id", "article_id", "similarity"]
            if not len(queries) or not len(rows):
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
            ids, wanted = queries.column("query_id").to_numpy(), _unit_rows(queries.column("vector").combine_chunks(), dimension)
            found, held = rows.column("article_id").to_numpy(), _unit_rows(rows.column("embedding").combine_chunks(), dimension)
            order = np.argsort(found, kind="stable")  # ties go to the lower key
            found, held = found[order], held[order]
            out = []
            for at in range(0, len(ids), 256):
                scores = wanted[at : at + 256] @ held.T
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out.append((np.repeat(ids[at : at + 256], best.shape[1]), found[best].ravel(), np.take_along_axis(scores, best, axis=1).ravel()))
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

        met = asks.groupBy(*keys).cogroup(rows.groupBy(*keys))
        return met.applyInArrow(product, "query_id long, article_id long, similarity double")

    def table(self) -> DataFrame:
        return self.spark.read.schema("article_id long, embedding array<float>, cell int").parquet(self.path)

    def search(self, query: Sequence[float], k: int, probes: int) -> DataFrame:
        """:func:`nearest_to` inside the probed cells; with all cells probed it is exact."""
        cells = self.probed_cells(query, probes)
        return nearest_to(self.table().filter(F.col("cell").isin(cells)), query, k)
