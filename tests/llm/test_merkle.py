import collections
import hashlib
import zlib

import pytest

from feedmill.llm import merkle, queries


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """All levels of a tree over a list of digests, bottom up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def others(levels, place):
    """(before, after) of a node on each level below the top."""
    found = []
    for nodes in levels[:-1]:
        first = place - place % 16
        found.append((nodes[first:place], nodes[place + 1 : first + 16]))
        place //= 16
    return found


def brute(rows):
    """The manifest of (doc_id, text, lang, source, n_chars) rows, in any order."""
    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf([doc_id, source, lang, n_chars, text])
        tampered = own
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            tampered = leaf([doc_id, source, lang, n_chars, low])
        groups[source].append((doc_id is not None, doc_id or 0, own, tampered, doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for number, s in enumerate(order):
        for place, (_, _, own, tampered, doc_id) in enumerate(sorted(groups[s], key=lambda r: r[:3])):
            path = others(trees[s], place) + others(top, number)
            node = tampered
            for before, after in path:
                node = h("".join([*before, node, *after]))
            proof = h("".join("".join(before + after) for before, after in path))
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op13_merkle(spark, str(tmp_path)).select(*COLUMNS).collect()), key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_given_table(spark, small):
    rows = [tuple(r) for r in queries.table(spark, small, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = sorted((tuple(r) for r in queries.op13_merkle(spark, small).select(*COLUMNS).collect()), key=str)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_trees_over_several_rounds_hot_and_null_sources_repeats_and_ties(spark, tmp_path):
    rows = [(i, f"Text {i % 97}", "en", "hot", i) for i in range(9000)]  # three rounds of stretches are not needed, two are
    rows += [(i, f"t{i}" if i % 3 else None, None, f"s{i % 40}", None) for i in range(900)]
    rows += [(i, "A" * (i % 5), "de", None, 1) for i in range(17)] + [(5, "same", "x", "one", 1)] * 3 + [(None, "", "", "", 0), (None, None, None, None, None)]
    rows += [(7, "tie B", "x", "tie", 1), (7, "tie A", "x", "tie", 1), (8, "ÄÖ long " * 20000, "x", "tie", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert run(spark, tmp_path, df.withColumn("place", merkle.F.lit("x"))) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 256, 257])
def test_small_trees(spark, tmp_path, n):
    rows = [(i, f"T{i}", "en", "s", 1) for i in range(n)]
    assert run(spark, tmp_path, spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_more_sources_than_a_run_of_single_leaves(spark, tmp_path):
    rows = [(i, f"T{i}", "en", f"s{i}", 1) for i in range(40)]
    assert run(spark, tmp_path, spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_paths_pack_and_a_changed_leaf_is_found():
    nodes = [h(str(i)).encode() for i in range(300)]
    levels = merkle.fold(nodes, 3)
    found = merkle.paths(levels, [(b"", h("x").encode())])
    assert len(levels[-1]) == 1 and all(merkle.unpack_path(merkle.pack_path(p)) == p for p in found)
    root = merkle.digest_of(levels[-1][0] + h("x").encode())
    assert all(merkle.refold(n, p) == root for n, p in zip(nodes, found))
    assert merkle.refold(nodes[1], found[0]) != root
