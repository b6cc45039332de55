import pytest
from pyspark.sql import functions as F, types as T

from feedmill.streaming.batches import write_batch
from feedmill.streaming.keyindex import KeyIndex
from feedmill.streaming.snapshots import Folder, KeyedTable, Manifests

ROW = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
SUM = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROW)


def held(table, spark, **how):
    return {r[0]: r[1] for r in table.read(spark, **how).collect()}


def test_newer_rows_win_before_and_after_compaction(spark, tmp_path):
    table = KeyedTable(str(tmp_path), ROW, "k")
    assert held(table, spark) == {}
    table.write(rows(spark, (1, "a"), (2, "b"), (None, "x")), 0)
    table.write(rows(spark, (2, "c"), (3, None)), 1)
    want = {1: "a", 2: "c", 3: None, None: "x"}
    assert held(table, spark) == want and held(table, spark, before=1) == {1: "a", 2: "b", None: "x"}
    table.compact(spark)
    assert held(table, spark) == want and table.pending(spark) == 0
    table.write(rows(spark, (1, "d")), 2)
    table.write(rows(spark, (1, "e")), 2)  # a repeated batch replaces its delta
    assert held(table, spark) == want | {1: "e"}
    table.compact(spark, before=2)  # nothing earlier is pending
    assert table.pending(spark) == 1
    with pytest.raises(ValueError):
        table.read(spark, before=1)


def test_sums(spark, tmp_path):
    table = KeyedTable(str(tmp_path), SUM, "k", sums=True)
    for batch in range(6):
        table.write(spark.createDataFrame([(1, 1), (batch, 10)], SUM).groupBy("k").agg(F.sum("n").alias("n")), batch)
        if batch in (2, 3):
            table.compact(spark)
    assert held(table, spark) == {0: 10, 1: 16, 2: 10, 3: 10, 4: 10, 5: 10}
    assert held(table, spark, before=5) == {0: 10, 1: 15, 2: 10, 3: 10, 4: 10}


def test_an_interrupted_compaction_leaves_the_old_state(spark, tmp_path, monkeypatch):
    table = KeyedTable(str(tmp_path), ROW, "k")
    table.write(rows(spark, (1, "a")), 0)
    table.compact(spark)
    table.write(rows(spark, (1, "b"), (2, "c")), 1)
    reader = table.read(spark)

    def stop(self, content):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        patched.setattr(Manifests, "publish", stop)
        with pytest.raises(RuntimeError):
            table.compact(spark)
    snapshots = Folder(spark, f"{tmp_path}/snapshots")
    assert held(table, spark) == {1: "b", 2: "c"} and len(snapshots.names()) == 2 and table.pending(spark) == 1
    table.compact(spark)
    assert held(table, spark) == {1: "b", 2: "c"} and len(snapshots.names()) == 2  # newest and the one before; the orphan is gone
    assert {r.k: r.v for r in reader.collect()} == {1: "b", 2: "c"}  # a reader that began before


def test_file_count_stays_bounded(spark, tmp_path):
    table = KeyedTable(str(tmp_path), ROW, "k")
    for batch in range(12):
        table.write(rows(spark, (batch % 3, str(batch))).coalesce(1), batch)
        if table.pending(spark) >= 3:
            table.compact(spark, before=batch + 1)
    assert held(table, spark) == {0: "9", 1: "10", 2: "11"}
    assert len(Folder(spark, f"{tmp_path}/deltas").names()) <= 6 and len(Folder(spark, f"{tmp_path}/snapshots").names()) <= 2
    assert len(Folder(spark, f"{tmp_path}/manifests").names()) <= 2


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def absent(index, spark, values, **how):
    return sorted(str(r.k) for r in index.absent(keys(spark, values), **how).collect())


def test_index_answers_like_the_whole_history(spark, tmp_path):
    index = KeyIndex(str(tmp_path), ["k"], buckets=16, fan=3)
    stored = set()
    for batch in range(8):
        values = [f"key {batch} {i}" for i in range(40)] + ["again", None][: batch + 1]
        fresh = index.absent(keys(spark, values), before=batch)
        want = {v for v in values if v not in stored}
        assert {r.k for r in fresh.collect()} == want
        index.merge(spark, before=batch)
        index.add(fresh, batch)
        stored |= want
        assert absent(index, spark, values) == []
    assert len(index._segments(spark, None)) <= 5
    assert absent(index, spark, ["key 0 1", "key 7 39", "new", None]) == ["new"]
    assert len(Folder(spark, f"{tmp_path}/keys").names()) <= 10


def test_new_keys_open_no_buckets_and_known_ones_only_theirs(spark, tmp_path):
    index = KeyIndex(str(tmp_path), ["k"], buckets=64)
    for batch in range(3):
        index.add(keys(spark, [f"{batch}/{i}" for i in range(2000)]), batch)
    assert len(absent(index, spark, [f"new {i}" for i in range(500)])) == 500
    assert len(index.opened) <= 5  # of 192: only where a filter errs
    assert absent(index, spark, ["1/77", "new"]) == ["new"]
    assert len(index.opened) <= 2


def test_a_repeated_batch_sees_only_earlier_ones(spark, tmp_path):
    index = KeyIndex(str(tmp_path), ["k", "m"], buckets=4)
    both = spark.createDataFrame([("a", 1), ("b", None)], "k string, m int")
    for _ in range(2):
        assert index.absent(both, before=0).count() == 2
        index.add(both, 0)
    assert index.absent(both, before=1).count() == 0 and len(index._segments(spark, None)) == 1
    assert index.absent(spark.createDataFrame([("a", None), ("b", 1)], "k string, m int"), before=1).count() == 2


def test_batches_are_plain_folders(spark, tmp_path):
    write_batch(rows(spark, (1, "a")), str(tmp_path / "t"), 3)
    assert Folder(spark, str(tmp_path / "t")).names() == ["batch_id=3"] and Folder(spark, str(tmp_path / "none")).names() == []
