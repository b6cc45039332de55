import collections
import zlib

from feedmill.llm import queries, shards


def check(rows, texts, n):
    """rows: (doc_id, source, size, crc, shard, slot)."""
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted(
        (d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in texts
    )
    per = collections.defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
    counts = [len(per.get(s, [])) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and set(per) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    mixture = collections.Counter((r.shard, r.source) for r in rows)
    for source, total in collections.Counter(r.source for r in rows).items():
        for s in range(n):
            assert abs(mixture[s, source] - total * counts[s] / len(rows)) <= 2


def test_mixture_and_sizes(spark):
    rows = [(i, f"text {i % 50}" if i % 7 else None, None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    rows += [(None, "", "x"), (None, "", "x"), (5, "text 5", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("slot", shards.F.lit(1))
    out = shards.interleave(df.repartition(7), 8, ["doc_id", "source", "slot"]).collect()
    check(out, rows, 8)
    again = shards.interleave(df.repartition(3), 8, ["doc_id", "source"]).collect()
    pick = lambda rs: sorted((str(r.doc_id), r.source or "", r.shard, r.slot) for r in rs)
    assert pick(out) == pick(again)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, "b", "s")], "doc_id long, text string, source string")
    assert {r.slot for r in shards.interleave(df, 40, ["doc_id"]).collect()} == {0}
    assert shards.interleave(df.limit(0), 40, ["doc_id"]).count() == 0


def test_query(spark, small):
    out = queries.QUERIES["op4_interleave"].run(spark, small)
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check(out.join(docs.select("doc_id", "source"), "doc_id").collect(), rows, 40)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_sources_of_one_row_spread_over_shards(spark):
    rows = [(i, f"text {i}", f"one {i}" if i % 3 == 0 else f"s{i % 2}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = shards.interleave(df, 10, ["doc_id", "source"]).collect()
    ones = collections.Counter(r.shard for r in out if r.source.startswith("one"))
    assert len(out) == 6000 and all(abs(ones[s] - 200) <= 60 for s in range(10))


def test_a_row_that_holds_a_third_of_the_table_is_spread(spark, monkeypatch):
    monkeypatch.setattr(shards, "COPIES_PER_BLOCK", 100)
    rows = [(7, "same", "hot")] * 2000 + [(i, f"text {i}", "hot" if i % 2 else f"s{i % 3}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = shards.interleave(df.repartition(5), 10, ["doc_id", "source"])
    out = placed.collect()
    check(out, [(d, t, s) for d, t, s in rows], 10)
    copies = collections.Counter(r.shard for r in out if r.size == 20 and r.text_crc32 == zlib.crc32(b"same"))
    assert sum(copies.values()) == 2000
