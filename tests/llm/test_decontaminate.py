import re

import pytest

from feedmill.llm import decontaminate
from feedmill.llm.queries import QUERIES
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=13):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, it in items:
            v = words(it)
            m = min(k, len(v))
            for s in range(len(v) - m + 1 if v else 0):
                for at in range(len(w) - m + 1):
                    if w[at : at + m] == v[s : s + m]:
                        hit |= set(range(at, at + m))
                        ids.add(str(i))
        out.append((d, len(w), len(hit), ",".join(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [
    (1, LONG), (1, LONG), (2, "Der Große Ömer, läuft"), (3, None), (4, "--"), (5, "solo"), (6, "the the"),
    (7, "the " * 20), (None, "zwei Worte hier noch und mehr davon"), (10, "W0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"),
]
DOCS = [
    (1, LONG), (1, LONG), (2, f"x y {LONG} z"), (3, "der große Ömer läuft"), (4, "der große ömer läuft"), (5, None), (6, ""),
    (7, "SOLO!"), (8, " ".join(f"w{i}" for i in range(14)) + " " + "pad " * 400), (9, "the the the " * 10), (None, "solo"),
    (None, None), (1, "other text w0 w1 w2"), (11, "w5 " + " ".join(f"w{i}" for i in range(13, 30)) + " w1"), (12, "İ solo ı"),
]


@pytest.mark.parametrize("limit", [0, decontaminate.BROADCAST_BYTES])
def test_against_brute_force(spark, limit):
    docs = spark.createDataFrame([(*d, "n") for d in DOCS], "doc_id long, text string, n_hit string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.contaminated(docs, items, broadcast_bytes=limit).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids or []), r.contaminated) for r in out), key=str)
    assert got == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert {(r.n_hit, r.contaminated) for r in decontaminate.contaminated(docs, items.limit(0)).collect()} == {(0, False)}


def test_query_equals_sql(spark, small, medium):
    q = QUERIES["op5_decontaminate"]
    for sf in (small, medium):
        frame = q.run(spark, sf)
        assert compare(frame, connect(sf), q.sql) == []
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_columns_of_the_input_may_have_any_name(spark):
    odd = ["_key", "_text", "_doc", "_hit", "_items", "_id", "_in0"]
    df = spark.createDataFrame([(1, "some plain words")], "doc_id long, text string")
    for name in odd:
        df = df.withColumn(name, decontaminate.F.lit(name))
    items = spark.createDataFrame([("i", "plain words")], "item_id string, text string")
    row = decontaminate.contaminated(df, items).collect()[0].asDict()
    assert [row[c] for c in odd] == odd and (row["n_words"], row["n_hit"], row["item_ids"], row["contaminated"]) == (3, 2, ["i"], True)
