import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from feedmill.llm import bpe

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS)


def ours(texts):
    import numpy as np

    return [np.frombuffer(ids, "<u4").tolist() for _, ids in ENCODER.many(texts)]


CASES = [
    "", " ", "  ", "\n", "a", "it's  they're\t'll've 'd'x' ''s !'s  's", "don't'st 'store 'rexx 'r 'l 'v I'M",
    "\r\n\r\n x  y　 z  ", "日本語テキスト 123４５ ①²½", "naïve café élan ÉÉ", "x" * 5000, "ab" * 3000 + "'s", "é" * 2000,
    "\x1c\x1d a\x85b​ c", "🙂🙂🏽 é 힣", "<|endoftext|> a", "12345 67 8", "$$$%%% ### a!!!", "\n\n\n a\n \n",
]


def test_cases_equal_the_library():
    assert ours(CASES) == [TIK.encode_ordinary(t) for t in CASES]
    assert ours(["".join(CASES)]) == [TIK.encode_ordinary("".join(CASES))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tstremvld.!aZ0é "), st.characters(codec="utf-8")), max_size=60), max_size=4))
def test_random_texts_equal_the_library(texts):
    assert ours(texts) == [TIK.encode_ordinary(t) for t in texts]


def test_every_assigned_class_splits_like_the_library():
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}\n" for c in range(k, min(k + 500, 0x110000)) if not 0xD800 <= c < 0xE000) for k in range(0, 0x32000, 500)]
    bad = [i for i, (a, t) in enumerate(zip(ours(texts), texts)) if a != TIK.encode_ordinary(t)]
    assert not bad


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=80), st.integers(0, 10**6))
def test_any_rank_table_merges_lowest_and_leftmost_first(piece, seed):
    import random

    r = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)} | {piece[i:j] for i in range(len(piece)) for j in range(i + 2, min(len(piece), i + 5) + 1) if r.random() < 0.7}
    order = sorted(tokens)
    r.shuffle(order)
    ranks = {t: i for i, t in enumerate(order)}
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1))
        if rank == 10**9:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    want = [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]
    merger = bpe.Merger(ranks)
    assert merger.encode(piece) == want
    assert not merger.buckets and not any(merger.words)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(CASES[5:]) * 40
    assert "".join(bpe.pieces(text, 50)) == text and sum(1 for _ in bpe.pieces(text, 50)) > 50
    assert [i for p in bpe.pieces(text, 50) for i in TIK.encode_ordinary(p)] == TIK.encode_ordinary(text)


def test_operator(spark):
    rows = [(1, "it's", "x"), (1, "it's", "x"), (2, None, None), (None, "", "y"), (3, "Größe " * 50000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.decode(bpe.encode(df, RANKS), RANKS).collect()
    assert len(out) == 5
    for r in out:
        text = r.text or ""
        assert bytes(r.decoded) == text.encode() and r.n_tokens == len(TIK.encode_ordinary(text))
    assert bpe.decode(bpe.encode(df.limit(0), RANKS), RANKS).count() == 0
    both = bpe.round_trip(df, RANKS)
    assert "text" not in both.columns and both.limit(0).count() == 0
    assert sorted(map(str, both.collect())) == sorted(map(str, bpe.decode(bpe.encode(df, RANKS), RANKS).select(both.columns).collect()))


def test_query_equals_the_library(spark, small):
    from feedmill.llm import queries

    out = queries.QUERIES["op1_bpe"].run(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        ids = TIK.encode_ordinary(texts[r.doc_id])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("line", [b"YQ== 0"])
def test_rank_file(tmp_path, line):
    (tmp_path / "r").write_bytes(line + b"\n")
    assert bpe.load_ranks(str(tmp_path / "r")) == {base64.b64decode(b"YQ=="): 0}


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_different_pretokens_with_one_name(spark, n):
    word, other = thue_morse(n)
    assert bpe.Encoder(RANKS).hash is not None
    texts = [word, other, f"{word}\n{other}\n{word}", f"x {other} {word} {other}"]
    assert ours(texts) == [TIK.encode_ordinary(t) for t in texts]
    rows = [(r.text, bytes(r.decoded).decode()) for r in bpe.decode(bpe.encode(spark.createDataFrame([(t,) for t in texts], "text string"), RANKS), RANKS).collect()]
    assert all(a == b for a, b in rows)


def test_names_alone_never_decide(monkeypatch):
    monkeypatch.setattr(bpe.RangeHash, "names", lambda self, starts, ends: (ends - starts).astype("uint64") % 3)  # nearly all names collide
    texts = CASES + ["the cat and the dog and the cat"]
    assert ours(texts) == [TIK.encode_ordinary(t) for t in texts]


UNSPACED = ["日本語の文章、句読点。だけで" * 40, "if(a1b2c3){d=e+f;}" * 60, "QUJD0aGVzZSBh9cmUgd29yZHM+/x" * 50, "it's'll''ve'd1's2'x" * 60, "a\tb\n\nc\u3000d\x85" * 60]


def test_texts_without_spaces_are_cut_where_pretokens_meet():
    for text in [*UNSPACED, "".join(UNSPACED), "".join(CASES)]:
        cut = list(bpe.pieces(text, 40))
        assert "".join(cut) == text and (text not in UNSPACED or max(map(len, cut)) < 100)
        assert [i for p in cut for i in TIK.encode_ordinary(p)] == TIK.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tstremvld.!aZ0é\x1c\x85"), st.characters(codec="utf-8")), max_size=80), st.integers(1, 9))
def test_any_text_in_pieces(text, limit):
    assert [i for p in bpe.pieces(text, limit) for i in TIK.encode_ordinary(p)] == TIK.encode_ordinary(text)


def test_long_unspaced_text_in_bounded_memory():
    import tracemalloc

    text = UNSPACED[0] * 8000
    tracemalloc.start()
    ((_, ids),) = bpe.Encoder(RANKS).many([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text.encode()) > 10 << 20 and peak < 200 << 20
    assert len(ids) // 4 == 8000 * 40 * len(TIK.encode_ordinary("日本語の文章、句読点。だけで" * 3)) // 3
