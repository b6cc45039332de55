import collections
import hashlib
import random

import numpy as np

from feedmill.llm import queries, repeats


def brute(texts, length):
    times = collections.Counter()
    for t in texts:
        for i in range(len(t) - length + 1):
            times[t[i : i + length]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        reach = 0
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[max(i, reach) : i + length] = True
                reach = i + length
        gone = gone[:-1]
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def test_cover():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(70), prose(45)
    texts = [prose(r.randint(1, 120)) for _ in range(25)]
    texts += [prose(20) + passage + prose(30), passage, passage + other, other + passage[:250] + prose(9), prose(5) + other[60:] + prose(4)]
    texts += [passage] * 4 + [texts[0]] * 3 + ["Heat " * 200, "x" * 199, "x" * 199, "x" * 200, "y" * 200, "y" * 200, "z" * 201, None, "", "é" * 150]
    near = prose(150).split(" ")
    for _ in range(5):
        copy = list(near)
        copy[r.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    return texts


def test_against_brute_force(spark):
    for seed, limit in ((1, repeats.BUCKET), (2, 50)):
        texts = corpus(seed)
        df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string").repartition(4)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(df, bucket=limit).collect()}
        want = brute([(t or "").encode() for t in texts], 200)
        assert [got[i] for i in range(len(texts))] == want


def test_strings_with_one_name_are_told_apart_by_their_bytes(spark):
    texts = corpus(4)
    want = brute([(t or "").encode() for t in texts], 200)
    for bits in (8, 13):  # thousands of strings share a few names
        for parts in (1, 7):
            df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
            got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(df, name_bits=bits).collect()}
            assert [got[i] for i in range(len(texts))] == want


def test_equal_strings():
    r = np.random.default_rng(1)
    one, other = r.integers(0, 2, 400, dtype=np.uint8), r.integers(0, 2, 400, dtype=np.uint8)
    other[50:300] = one[60:310]
    a = np.concatenate([np.arange(40, 200), r.integers(0, 390, 100)])
    b = np.concatenate([np.arange(30, 190), r.integers(0, 390, 100)])
    want = [bytes(one[x : x + 9]) == bytes(other[y : y + 9]) for x, y in zip(a, b)]
    assert repeats.equal(one, a, other, b, 9).tolist() == want and any(want) and not all(want)


def test_whole_characters(spark):
    texts = corpus(3)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = repeats.remove_repeats(df, whole_characters=True).collect()
    assert len(out) == len(texts) and all(bytes(r.kept).decode() is not None for r in out)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(5000)), np.uint8)
    starts = np.arange(0, 4801, 3)
    whole = repeats.names_at(data, starts, 200)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 256)
    assert (repeats.names_at(data, starts, 200) == whole).all()


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = brute([r.text.encode() for r in rows], 200)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op7_repeats"].run(spark, small).collect()}
    assert got == {r.doc_id: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for r, w in zip(rows, want)}


def test_buckets_tell_names_apart_that_differ_in_the_bits_not_sent():
    for buckets in (32, 33, 48, 256, 1000):
        names = (np.arange(256, dtype=np.uint64) << np.uint64(56)) + np.uint64(0x0012345600ABCDEF)
        _, edges = repeats._dealt(names, buckets)
        assert np.diff(edges).max() <= -(-256 // buckets)
