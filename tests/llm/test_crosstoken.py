import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from feedmill.llm import crosstoken, queries

with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
    JSON = file.read()
with open(P.path("piece_bpe_32k.model"), "rb") as file:
    MODEL = file.read()
A = Tokenizer.from_str(JSON)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_proto=MODEL)
ALPHABET = crosstoken.byte_alphabet()


def tokens(text):
    """[(id, first byte, end byte)] of both tokenizers for the whole text, or nothing."""
    if not text:
        return [], []
    want = b" " + text.encode()
    a = [(i, bytes(ALPHABET[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
        return [], []
    placed = []
    for side in (a, b):
        at, own = 0, []
        for i, t in side:
            own.append((i, at, at + len(t)))
            at += len(t)
        placed.append(own)
    return tuple(placed)


def brute_links(a, b):
    return [(x, y, min(e, g) - max(s, f)) for x, (_, s, e) in enumerate(a) for y, (_, f, g) in enumerate(b) if s < g and f < e]


def brute_groups(a, b):
    both = sorted({e for _, _, e in a} & {e for _, _, e in b})
    out, first = [], 0
    for end in both:
        own = [[i for i, s, _ in side if first <= s < end] for side in (a, b)]
        out.append(own)
        first = end
    return out


def spelled(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def brute(rows):
    docs = []
    for doc_id, text in rows:
        a, b = tokens(text)
        docs.append((doc_id, a, b, [(a[x][0], b[y][0]) for x, y, _ in brute_links(a, b)], brute_groups(a, b)))
    count = collections.Counter(p for d in docs for p in set(d[3]))
    most = collections.Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return sorted(
        (
            (doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(spelled(groups).encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups))
            for doc_id, a, b, links, groups in docs
        ),
        key=str,
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]
CASES = [
    "", " ", "  ", "a", "a  b   c \n d\t\n  e", " lead", "trail ", "<|endoftext|> <s> </s> <0x41> <unk>", "x" * 300, "日本語 テキスト 123４５ ①²½ 鿿",
    "▁ mark a▁b", "naïve café é", "\x1c a\x1d \x85b c​ d　 e", "🙂 🙂🏽", "it's they're", "\x00 nul �", "a \x1cb", "a  b", "the the the",
]


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op11_crosstoken(spark, str(tmp_path)).select(*COLUMNS).collect()), key=str)


def test_query_on_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(crosstoken, "CHUNK_BYTES", 200)  # many chunks ask for the same pairs
    rows = [(i, t) for i, t in enumerate(CASES * 2)] + [(None, None), (None, None), (5, "the the"), (99, "long words here " * 3000)]
    assert run(spark, tmp_path, rows[:-1]) == brute(rows[:-1])


def test_given_table(spark, small, tmp_path):
    rows = [tuple(r) for r in queries.table(spark, small, "documents").select("doc_id", "text").collect()]
    short = sorted(rows, key=lambda r: len(r[1] or ""))[:120]
    assert run(spark, tmp_path, short) == brute(short)
    whole = {r.doc_id: r for r in queries.op11_crosstoken(spark, small).collect()}
    assert len(whole) == len(rows)
    for doc_id, text in random.Random(1).sample(rows, 40):
        a, b = tokens(text)
        groups = brute_groups(a, b) if len(a) < 2000 else None
        assert (whole[doc_id].n_a, whole[doc_id].n_b) == (len(a), len(b))
        if groups and a:
            assert whole[doc_id].groups_sha256 == hashlib.sha256(spelled(groups).encode()).hexdigest()


def test_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, which string").withColumn("n_a", crosstoken.F.lit("mine"))
    assert crosstoken.link_statistics(df.limit(0), JSON, MODEL).count() == 0
    out = {r.doc_id: r for r in crosstoken.link_statistics(df, JSON, MODEL, ["doc_id", "n_a", "extra"][:2]).collect()}
    assert out[1].n_a == 2 and out[2].n_a == 0
    rows = crosstoken.align(df, JSON, MODEL).collect()
    assert [r.which for r in sorted(rows)] == ["x", "y"] and {r.groups for r in rows} == {spelled(brute_groups(*tokens("a b"))), ""}


def test_links_of_positions(spark):
    text = "Größe naïve 日本語  ok tokenization"
    row = crosstoken.align(spark.createDataFrame([(text,)], "text string"), JSON, MODEL).first()
    a, b = tokens(text)
    assert row.a_ids == [i for i, _, _ in a] and row.b_ids == [i for i, _, _ in b]
    assert sorted(tuple(x) for x in row.links) == sorted(brute_links(a, b))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tse.!aZ0é \x1c▁"), st.characters(codec="utf-8")), max_size=40), max_size=3))
def test_parts_equal_whole_texts(texts):
    aligner = ALIGNER
    numbers, links, groups = aligner.many(texts)
    for k, text in enumerate(texts):
        a, b = tokens(text)
        want = brute_links(a, b)
        assert numbers[k].tolist()[:4] == [len(a), len(b), len(brute_groups(a, b)), len(want)]
        assert links.of(np.array([k])).tolist() == [(a[x][0] << crosstoken.SHIFT) | b[y][0] for x, y, _ in want]
        assert groups.of(np.array([k])).tobytes().decode()[:-1] == spelled(brute_groups(a, b))


ALIGNER = crosstoken.Aligner(JSON, MODEL)


def test_whole_texts_as_parts_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(crosstoken, "REMEMBERED_BYTES", 1000)
    cutting, whole = crosstoken.Aligner(JSON, MODEL), crosstoken.Aligner(JSON, MODEL)
    whole.tokenizers.can_cut = False
    for k in range(0, len(CASES), 3):
        x, y = cutting.many(CASES[k : k + 3]), whole.many(CASES[k : k + 3])
        assert x[0].tolist() == y[0].tolist() and x[1].values.tolist() == y[1].values.tolist() and x[2].values.tobytes() == y[2].values.tobytes()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_product_equals_dense(seed):
    r = np.random.default_rng(seed)
    left, right = r.integers(0, 3, (4, 5)) * (r.random((4, 5)) < 0.4), r.integers(0, 3, (5, 6)) * (r.random((5, 6)) < 0.4)

    def csr(m):
        rows, cols = np.nonzero(m)
        return crosstoken.Csr(np.append(0, np.cumsum(np.bincount(rows, minlength=len(m)))), cols, m[rows, cols])

    got = crosstoken.product(csr(left), csr(right), 6)
    dense = np.zeros((4, 6), np.int64)
    dense[got.rows(), got.index] = got.data
    assert (dense == left @ right).all() and (got.data > 0).all()
    flipped = crosstoken.transposed(csr(left), 5)
    dense = np.zeros((5, 4), np.int64)
    dense[flipped.rows(), flipped.index] = flipped.data
    assert (dense == left.T).all()
