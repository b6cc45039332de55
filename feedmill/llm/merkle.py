"""Merkle manifest of a dataset by time-forward processing [op13].

Every row is a leaf: the digest of its values, each framed by its length.  The leaves of a source, by id, are folded in
runs of ``ARITY`` to a subroot; the subroots, by source, are folded the same way to the root.

Nodes are labelled by (tree, level, place); a parent's label is its children's with the place divided by the arity.  The
forward sweep is time-forward processing: digests are messages to the label of their parent, ordered by it, and a
node takes what has arrived for it in that order.  Spark's sorted shuffle is the external queue between stretches
of ``ARITY ** LEVELS`` nodes; inside a stretch, which one task holds at a time, a queue of (label, digest) hands child digests
to parents.  So a round of shuffling climbs ``LEVELS`` levels.  The reversed sweep goes the same rounds down: a stretch
receives the suffix of its top node's proof and hands every node its siblings and the suffix of its parent.

* Rows move once as digests of 32 bytes; texts never leave their scan.  Places come from counts by stretch of a range
  partitioning, so a source with a third of all rows is spread like any other.
* Null values are framed as ``-``; a null source is a tree of its own and the first; null ids come first in their source.
* Equal ids are ordered by their leaf digests, so repeated rows give the same roots in any order of the files.
* An empty table has no rows and so no root.  Very long texts are hashed by the JVM as one value each.
* Columns of the input that are not read are not moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmill.operators.state import running_count
from feedmill.session import staged

ARITY = 16
#: Levels that one task folds of a stretch: 16 ** 3 = 4,096 nodes.
LEVELS = 3
STRETCH = ARITY**LEVELS


def framed(value: Column) -> Column:
    """A value with its length, so that different rows never frame alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row's values as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[framed(v) for v in values]).cast("binary"), 256))


# --- one stretch; digests are lowercase hex as bytes --------------------------------------

#: What stands before and after a node in its run, and so on for every level above it.
Path = list[tuple[bytes, bytes]]


def digest_of(run: bytes) -> bytes:
    return hashlib.sha256(run).hexdigest().encode()


def levels_above(nodes: int) -> int:
    """Levels that one climb takes a tree of so many nodes: up to ``LEVELS``, and none above a single node."""
    climbed = 0
    while nodes > 1 and climbed < LEVELS:
        nodes, climbed = -(-nodes // ARITY), climbed + 1
    return climbed


def fold(leaves: Sequence[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each level of a stretch by time-forward processing; the last level is its top.

    The queue holds (level, place, sender, digest).  Nodes come off in the order of their labels (level, place); the
    children of a node are the messages that carry its label.
    """
    found: list[list[bytes]] = [[] for _ in range(levels + 1)]
    queue = [(0, place, place, digest) for place, digest in enumerate(leaves)]
    heapify(queue)
    while queue:
        level, place = queue[0][:2]
        arrived = []
        while queue and queue[0][0] == level and queue[0][1] == place:
            arrived.append(heappop(queue)[3])
        node = digest_of(b"".join(arrived)) if level else arrived[0]
        found[level].append(node)
        if level < levels:
            heappush(queue, (level + 1, place // ARITY, place, node))
    return found


def paths(levels: list[list[bytes]], above: Path) -> list[Path]:
    """The path of every node of the lowest level, by a sweep from the top down that hands each its parent's path."""
    suffixes = [above]
    for nodes in levels[-2::-1]:
        below = []
        for place in range(len(nodes)):
            first = place - place % ARITY
            own = b"".join(nodes[first:place]), b"".join(nodes[place + 1 : first + ARITY])
            below.append([own, *suffixes[place // ARITY]])
        suffixes = below
    return suffixes


def refold(node: bytes, path: Path) -> bytes:
    """What a path makes of a node: the root, if the node is the one the path was made for."""
    for before, after in path:
        node = digest_of(before + node + after)
    return node


def pack_path(path: Path) -> bytes:
    """Two counts and the digests for each level."""
    return b"".join(bytes([len(b) // 64, len(a) // 64]) + bytes.fromhex((b + a).decode()) for b, a in path)


def unpack_path(data: bytes) -> Path:
    path, at = [], 0
    while at < len(data):
        before, after = data[at], data[at + 1]
        middle, end = at + 2 + 32 * before, at + 2 + 32 * (before + after)
        path.append((data[at + 2 : middle].hex().encode(), data[middle:end].hex().encode()))
        at = end
    return path


# --- whole trees --------------------------------------------------------------------------

NODES = "tree long, place long, digest binary, total long"
SUFFIXES = "tree long, place long, suffix binary, subroot binary"


def _rows(names: str, *columns: list) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in names.split(", ")]
    return pa.table([pa.array(values, kinds[kind]) for values, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])


def _levels(nodes: pa.Table) -> list[list[bytes]]:
    """The levels over the nodes of a stretch, which are ordered by place."""
    digests = [d.hex().encode() for d in nodes.column("digest").to_pylist()]
    return fold(digests, levels_above(nodes.column("total")[0].as_py()))


def _climb(key, nodes):
    """The one top node of a stretch, in the numbering of its own level."""
    levels, left = _levels(nodes.sort_by("place")), nodes.column("total")[0].as_py()
    for _ in levels[1:]:
        left = -(-left // ARITY)
    return _rows(NODES, [key[0].as_py()], [key[1].as_py()], [bytes.fromhex(levels[-1][0].decode())], [left])


def _stretch() -> Column:
    """The stretch of a node; its top has the stretch's number as its place."""
    return F.expr(f"place div {STRETCH}L").alias("stretch")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of every round, from the given ones to the last, in which every tree has one node."""
    rounds = [nodes]
    while not rounds[-1].filter("total > 1").isEmpty():
        rounds.append(staged(rounds[-1].groupBy("tree", _stretch()).applyInArrow(_climb, NODES), "nodes"))
    return rounds


def _meeting(nodes: DataFrame, above: DataFrame):
    """Stretches of nodes with what their top nodes have received."""
    return nodes.groupBy("tree", _stretch()).cogroup(above.groupBy("tree", F.col("place").alias("stretch")))


def _descend(key, nodes, above):
    nodes = nodes.sort_by("place")
    found = paths(_levels(nodes), unpack_path(above.column("suffix")[0].as_py()))
    n, subroot = len(found), above.column("subroot")[0].as_py()
    return _rows(SUFFIXES, [key[0].as_py()] * n, nodes.column("place").to_pylist(), [pack_path(p) for p in found], [subroot] * n)


def descend(rounds: list[DataFrame], top: DataFrame, until: int) -> DataFrame:
    """What the nodes of round ``until`` receive, given what those of the last round have received."""
    received = top
    for index in range(len(rounds) - 2, until - 1, -1):
        received = staged(_meeting(rounds[index], received).applyInArrow(_descend, SUFFIXES), "suffixes")
    return received


def _numbered_groups(leaves: DataFrame) -> DataFrame:
    """(group, total, tree): the groups in order, null first; one row each."""
    counts = leaves.groupBy("_group").agg(F.count("*").alias("total"))
    ordered = counts.select("_group", "total", F.lit(0).alias("_one"), F.col("_group").isNotNull().cast("int").alias("_named"))
    numbered = running_count(ordered, "_one", "_named", "_group", "_number")
    return staged(numbered.select(F.col("_group").alias("_of"), "total", (F.col("_number") - 1).cast("long").alias("tree")), "trees")


def _prove(root: bytes, keys: T.StructField) -> tuple:
    """The function for a stretch of leaves with what its top received, and the schema of its rows."""
    schema = T.StructType([keys, *T._parse_datatype_string("leaf string, subroot string, root string, proof string, folded_root string, verified boolean").fields])

    def run(key, nodes, above):
        nodes = nodes.sort_by("place")
        found = paths(_levels(nodes), unpack_path(above.column("suffix")[0].as_py()))
        proofs, folded = [], []
        for path, digest, changed in zip(found, nodes.column("digest").to_pylist(), nodes.column("found").to_pylist()):
            proofs.append(digest_of(b"".join([part for level in path for part in level])).decode())
            folded.append(refold((digest if changed is None else changed).hex().encode(), path).decode())
        n = len(found)
        leaves = [d.hex() for d in nodes.column("digest").to_pylist()]
        subroot = above.column("subroot")[0].as_py().hex()
        columns = [leaves, [subroot] * n, [root.hex()] * n, proofs, folded]
        arrays = [nodes.column("key").combine_chunks(), *[pa.array(c, pa.string()) for c in columns], pa.array([f == root.hex() for f in folded], pa.bool_())]
        return pa.table(arrays, names=schema.names)

    return run, schema


def manifest(df: DataFrame, values: Sequence[str], key: str = "doc_id", group: str = "source", found: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof, folded_root, verified) of every row.

    ``values`` are the columns of a leaf.  ``found`` is the leaf digest of what is to be verified, null where that is the
    row itself; ``proof`` is the digest of the siblings from the leaf to the root, and ``folded_root`` what they make of it.
    """
    digest = leaf_digest([F.col(v) for v in values])
    rows = df.select(F.col(key).alias("key"), F.col(group).cast("string").alias("_group"), digest.alias("digest"), (F.lit(None).cast("binary") if found is None else found).alias("found"))
    placed = staged(running_count(rows, "_group", "key", "digest", "_number"), "leaves")
    trees = _numbered_groups(placed)
    joined = placed.join(trees, F.col("_group").eqNullSafe(F.col("_of")))
    leaves = staged(joined.select("tree", (F.col("_number") - 1).cast("long").alias("place"), "digest", "total", "key", "found"), "leaves")

    rounds = climb(leaves.select("tree", "place", "digest", "total"))
    subroots = rounds[-1]
    groups = trees.count()
    upper = climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(groups).cast("long").alias("total")))
    top = upper[-1].select("tree", "place", F.lit(b"").alias("suffix"), F.lit(b"").alias("subroot"))
    first = upper[-1].first()
    run, schema = _prove(bytes(first.digest) if first else b"", T.StructField(key, df.schema[key].dataType))

    of_groups = descend(upper, top, 0).select(F.col("place").alias("tree"), "suffix")
    received = subroots.select("tree", "place", F.col("digest").alias("subroot")).join(of_groups, "tree")
    above = descend(rounds, staged(received.select("tree", "place", "suffix", "subroot"), "received"), 1)
    return _meeting(leaves, above).applyInArrow(run, schema)
