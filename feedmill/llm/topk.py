"""Exact top-k search by inner product with ball trees [op10].

Vectors are dealt to shards of about ``SHARD`` rows: cells of a small tree over a bounded sample put near
vectors together, and large cells (one vector may be a third of all rows) are cut further by a hash of the
id.  Each shard builds a ball tree; a node's inner products are at most q.c + |q| r, and its leaves are searched
in order of that bound, as long as the bound reaches the query's current k-th score.

1. Every query is searched in its own shard, which gives a first k-th score.
2. Queries are compared in blocks with the balls of the other shards, and visit only those whose bound
   reaches that k-th score; it is handed on and raised from leaf to leaf.
3. The best k of all visits are kept, first by combined partial ranks.

Bounds have a margin for rounding and scores are exact integers, so nothing is lost by pruning.  The
sample only decides where vectors lie, never which ones are searched.

* Components are read as floor(scale * x).  Vectors that are null or hold null or non-finite components,
  and rows with null ids, take no part.  Only vectors of equal length are compared.
* Ties go to the smaller id.  A query's own id is never its candidate.  Rows that repeat an id and
  vector count once; an id with different vectors is a candidate with each, and a query with each.
* Scores beyond 64 bits are cut to the largest or smallest long.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD = 8192
LEAF = 128
SAMPLE = 4096
QUERY_BLOCK = 1024
BALL_BLOCK = 1024
_LOW = -(2**63)

_FOUND = "query_key long, query_id long, vec_id long, score long"
_HITS = pa.schema([(n, pa.int64()) for n in ("query_key", "query_id", "vec_id", "score")])


def scaled(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, size, vec) with the integer components as packed doubles, one row per different vector of an id."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~np.isfinite(values) | flat.is_null().to_numpy(zero_copy_only=False), out=bad[1:])
            ends = np.cumsum(sizes)
            starts = ends - sizes
            good = (bad[ends] == bad[starts]) & column.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(all="ignore"):
                whole = np.floor(values * scale) + 0.0
            packed = [whole[a:b].tobytes() for a, b in zip(starts[good].tolist(), ends[good].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), pa.array(sizes[good], pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "size", "vec"]
            )

    return df.select(F.col(vec_id).cast("long"), F.col(embedding)).mapInArrow(run, "vec_id long, size int, vec binary")


def matrix(packed: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), size)


def _halves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A direction through two far points of the rows, and every row's place on it."""
    a = rows[np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1))]
    b = rows[np.argmax(((rows - a) ** 2).sum(axis=1))]
    return b - a, rows @ (b - a)


class BallTree:
    """Nodes in breadth-first order with centre, radius, smallest id and bounds; leaves hold at most ``leaf`` rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.parent, self.members, self.centre, self.radius, self.least = [], [], [], [], []
        self.leaves: list[int] = []
        todo = [(np.arange(len(ids)), -1)]
        while todo:
            own, parent = todo.pop(0)
            node, points = len(self.parent), self.rows[own]
            centre = points.mean(axis=0)
            self.parent.append(parent)
            self.members.append(own)
            self.centre.append(centre)
            self.radius.append(np.sqrt(((points - centre) ** 2).sum(axis=1).max(initial=0.0)))
            self.least.append(self.ids[own].min())
            if len(own) <= leaf:
                self.leaves.append(node)
                continue
            place = np.argsort(_halves(points)[1], kind="stable") if self.radius[-1] > 0 else np.arange(len(own))
            half = len(own) // 2
            todo += [(np.sort(own[place[:half]]), node), (np.sort(own[place[half:]]), node)]
        self.centre = np.array(self.centre).reshape(len(self.parent), rows.shape[1])
        self.radius, self.least = np.array(self.radius), np.array(self.least)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, a score that no row below the node exceeds."""
        own = upper_bounds(queries, self.centre, self.radius)
        for node, parent in enumerate(self.parent):
            if parent >= 0:
                own[:, node] = np.minimum(own[:, node], own[:, parent])
        return own


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    length = np.sqrt((queries**2).sum(axis=1))[:, None]
    reach = np.sqrt((centres**2).sum(axis=1))[None, :] + radii[None, :]
    return queries @ centres.T + length * radii[None, :] + 1e-9 * length * reach + 1e-6


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; beyond doubles' whole numbers they are computed with Python's."""
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in rows]
    out = np.empty((len(queries), len(rows)), np.int64)
    for i, query in enumerate(queries):
        q = [int(x) for x in query]
        out[i] = [max(_LOW, min(2**63 - 1, sum(a * b for a, b in zip(q, row)))) for row in whole]
    return out


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of the best k rows per query that reach its ``kth`` score.

    ``kth`` holds scores that k other rows are known to reach (or the smallest long).
    """
    n = len(queries)
    scores, found = np.full((n, k), _LOW), np.full((n, k), np.iinfo(np.int64).max)
    filled = np.zeros(n, np.int64)
    bounds = tree.bounds(queries)[:, tree.leaves]
    least = tree.least[tree.leaves]
    order = np.argsort(-bounds, axis=1, kind="stable")
    floor = kth.astype(np.int64).copy()
    for turn in range(len(tree.leaves)):
        leaf = order[:, turn]
        bound = np.take_along_axis(bounds, leaf[:, None], axis=1)[:, 0]
        full = filled >= k
        beaten = full & (bound < scores[:, -1] + 1) & (least[leaf] > found[:, -1])
        alive = np.flatnonzero((bound >= floor) & ~beaten)
        if not len(alive):
            if (bound < floor).all():
                break
            continue
        for one in np.unique(leaf[alive]).tolist():
            who = alive[leaf[alive] == one]
            rows = tree.members[tree.leaves[one]]
            new = products(queries[who], tree.rows[rows])
            other = np.broadcast_to(tree.ids[rows], new.shape)
            usable = (other != ids[who][:, None]) & (new >= floor[who][:, None])
            some = usable.any(axis=1)
            if not some.any():
                continue
            who, new, other, usable = who[some], new[some], other[some], usable[some]
            all_scores = np.concatenate([scores[who], np.where(usable, new, _LOW)], axis=1)
            all_ids = np.concatenate([found[who], np.where(usable, other, np.iinfo(np.int64).max)], axis=1)
            best = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
            scores[who] = np.take_along_axis(all_scores, best, axis=1)
            found[who] = np.take_along_axis(all_ids, best, axis=1)
            filled[who] = (found[who] != np.iinfo(np.int64).max).sum(axis=1)
            done = who[filled[who] >= k]
            floor[done] = np.maximum(floor[done], scores[done, -1])
    at, place = np.nonzero(found != np.iinfo(np.int64).max)
    return at, found[at, place], scores[at, place]


def _cells(sample: np.ndarray, count: int) -> list[tuple[np.ndarray, float, int, int]]:
    """Splits (direction, cut, left, right) of a tree with ``count`` leaves; negative children are cells."""
    splits: list = []
    cells = 0

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal cells
        direction, place = _halves(rows) if want > 1 and len(rows) > 1 else (None, None)
        if direction is None or place.max() == place.min():
            cells += 1
            return -cells
        at, cut = len(splits), float(np.median(place))
        cut = cut if (place <= cut).any() and (place > cut).any() else float(place.min())
        splits.append(None)
        low = place <= cut
        splits[at] = (direction, cut, grow(rows[low], want // 2), grow(rows[~low], want - want // 2))
        return at

    grow(sample, count)
    return splits


def _route(splits: list, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    todo = [(0, np.arange(len(rows)))] if splits else []
    while todo:
        node, own = todo.pop()
        if node < 0:
            out[own] = -node
            continue
        direction, cut, left, right = splits[node]
        low = rows[own] @ direction <= cut
        todo += [(left, own[low]), (right, own[~low])]
    return out


def top_k(
    df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding",
    shard: int = SHARD, leaf: int = LEAF,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k of all rows for each row whose id is divisible by ``every``."""
    vectors = scaled(df, vec_id, embedding, scale)
    total = df.count()
    sample = vectors.select("size", "vec").orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).collect()
    wanted = min(SAMPLE // 8, -(-max(total, 1) // shard))
    splits = {s: _cells(matrix([bytes(r.vec) for r in sample if r.size == s], s), wanted) for s in {r.size for r in sample}}

    def route(batches):
        for batch in batches:
            sizes, packed = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            cells = np.zeros(len(packed), np.int64)
            for size in set(sizes.tolist()):
                own = np.flatnonzero(sizes == size)
                cells[own] = _route(splits.get(size, []), matrix([packed[i] for i in own], size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["vec_id", "size", "vec", "cell"])

    routed = vectors.mapInArrow(route, "vec_id long, size int, vec binary, cell long")
    sizes = routed.groupBy("size", "cell").agg(F.ceil(F.count("*") / shard).alias("parts"))
    key = F.xxhash64("size", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    placed = routed.join(sizes, ["size", "cell"]).select("vec_id", "size", "vec", key.alias("shard"))

    def different(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes], int]:
        size = table["size"][0].as_py()
        rows = sorted(set(zip(table["vec_id"].to_pylist(), table["vec"].to_pylist())))
        return np.array([r[0] for r in rows]), matrix([r[1] for r in rows], size), [r[1] for r in rows], size

    def query_keys(packed: list[bytes]) -> np.ndarray:
        import xxhash

        return np.array([xxhash.xxh3_64_intdigest(p) for p in packed], np.uint64).view(np.int64)

    def hits(keys, ids, at, found, scores) -> pa.Table:
        return pa.table([keys[at], ids[at], found, scores], schema=_HITS)

    def home(table: pa.Table) -> pa.Table:
        """The shard's ball, and its own queries with what they find here (k rows, fewer if there are not as many)."""
        ids, rows, packed, size = different(table)
        number, tree = table["shard"][0].as_py(), BallTree(ids, rows, leaf)
        own = np.flatnonzero(ids % every == 0)
        keys = query_keys([packed[i] for i in own])
        at, found, scores = search(tree, ids[own], rows[own], np.full(len(own), _LOW), k)
        counts = np.bincount(at, minlength=len(own))
        kth = np.full(len(own), _LOW)
        last = np.flatnonzero(counts >= k)
        kth[last] = scores[np.searchsorted(at, last, side="right") - 1]
        out = [(number, size, tree.centre[0].tobytes(), float(tree.radius[0]), None, None, None, None, None)]
        out += [(number, size, packed[i], None, int(ids[i]), int(q), int(t), None, None) for i, q, t in zip(own, keys, kth)]
        out += [(number, size, None, None, int(ids[own[a]]), int(keys[a]), None, int(f), int(s)) for a, f, s in zip(at, found, scores)]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.float64()] + [pa.int64()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["shard", "size", "vec", "radius", "query_id", "query_key", "kth", "vec_id", "score"])

    from feedmill.session import staged

    first = placed.groupBy("shard").applyInArrow(
        home, "shard long, size int, vec binary, radius double, query_id long, query_key long, kth long, vec_id long, score long"
    )
    first = staged(first, "home")
    balls = first.filter("radius IS NOT NULL").select("shard", "size", "vec", "radius")
    asked = first.filter("kth IS NOT NULL").select("shard", "size", "vec", "query_id", "query_key", "kth")
    numbers = {name: max(1, -(-frame.count() // block)) for name, frame, block in (("q", asked, QUERY_BLOCK), ("b", balls, BALL_BLOCK))}

    def meet(queries: pa.Table, others: pa.Table) -> pa.Table:
        """Which shards of a block each query of a block has to visit."""
        out: list = []
        if queries.num_rows and others.num_rows:
            size = queries["size"][0].as_py()
            q = matrix(queries["vec"].to_pylist(), size)
            bounds = upper_bounds(q, matrix(others["vec"].to_pylist(), size), others["radius"].to_numpy())
            there = others["shard"].to_numpy()
            visit = (bounds >= queries["kth"].to_numpy()[:, None]) & (there[None, :] != queries["shard"].to_numpy()[:, None])
            at, to = np.nonzero(visit)
            names = ("size", "vec", "query_id", "query_key", "kth")
            return pa.table([pa.array(there[to])] + [queries[n].take(pa.array(at)) for n in names], names=["shard", *names])
        kinds = [("shard", pa.int64()), ("size", pa.int32()), ("vec", pa.binary()), ("query_id", pa.int64()), ("query_key", pa.int64()), ("kth", pa.int64())]
        return pa.table([out] * 6, schema=pa.schema(kinds))

    blocked = asked.withColumn("qb", F.pmod(F.xxhash64("query_key", "query_id"), F.lit(numbers["q"])))
    blocked = blocked.withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(numbers["b"] - 1))))
    opened = balls.withColumn("bb", F.pmod(F.xxhash64("shard"), F.lit(numbers["b"])).cast("int"))
    opened = opened.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(numbers["q"] - 1).cast("long"))))
    visits = blocked.groupBy("qb", "bb", "size").cogroup(opened.groupBy("qb", "bb", "size")).applyInArrow(
        meet, "shard long, size int, vec binary, query_id long, query_key long, kth long"
    )
    visits = staged(visits, "visits")
    load = visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    callers = visits.join(load, "shard").withColumn("part", F.pmod(F.xxhash64("query_key", "query_id"), F.col("blocks")))
    hosts = placed.join(load, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def visit(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table([[]] * 4, schema=_HITS)
        ids, points, _, size = different(rows)
        tree = BallTree(ids, points, leaf)
        own = queries["query_id"].to_numpy()
        at, found, scores = search(tree, own, matrix(queries["vec"].to_pylist(), size), queries["kth"].to_numpy(), k)
        return hits(queries["query_key"].to_numpy(), own, at, found, scores)

    away = callers.groupBy("shard", "part").cogroup(hosts.groupBy("shard", "part")).applyInArrow(visit, _FOUND)
    at_home = first.filter("vec_id IS NOT NULL").select("query_key", "query_id", "vec_id", "score")
    rank = F.row_number().over(W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    best = at_home.union(away).distinct().withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
