import collections
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedmill.llm import packing, queries, words

with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
    JSON = file.read()
TOKENIZER = Tokenizer.from_str(JSON)
TOKENIZER.encode_special_tokens = True
IDS = packing.TokenIds(JSON)

CASES = [
    "", " ", "  ", "\n", "a", "a  b   c \n d\t\n  e", "it's  they're 'x", " lead", "x" * 5000, "<|endoftext|> a <|endoftext|>",
    "日本語 テキスト 123４５ ①²½", "naïve café", "\x1c a\x1d \x1e b\x85 c​ d　 e", "a \x1cb  \x85c", "🙂 🙂🏽 é é", "\r\n\r\n x", "a  b  c",
]


def whole(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def check_ids(texts):
    got = IDS.many(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole(t) for t in texts]


def test_parts_give_the_ids_of_the_whole_text():
    check_ids(CASES)
    check_ids(["".join(CASES), " ".join(CASES) * 20])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tse.!aZ0é \x1c"), st.characters(codec="utf-8")), max_size=60), max_size=4))
def test_random_texts(texts):
    check_ids(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\x1c\x85\u00a0\u2003\u3000ab."), max_size=12))
def test_both_ways_of_cutting_give_the_same_parts(text):
    assert words.parts_of(text) == words._SPACE.split(text)


MARKED = [
    "it's 'tis don'tx a's's 3.14 1a2b _a_b a_b x--'s y'd've", "(a) [b]{c} d/e f: g; h! \"i\" j... k,l,,m", "a\nb a\n\nb a \nb a\n b a\t\nb a\r\nb\n",
    "café, naïve! œuvre. слово, слово. ß; ×, 5÷, ª. µ, ö\nÖ Ω, 日本. ٣, ½.", "a\u2003 b\u2003\nc\u00a0 d\x85 e\u3000\n f\u200b g\x1c h\x1f\ni\x7f j", "\n", "\na", ".", ".a", " .", "a.",
]


def test_pieces_give_the_ids_of_the_whole_text():
    check_ids(MARKED)
    check_ids(["".join(MARKED), "", " ".join(MARKED) * 20])
    assert IDS.many([]) == []


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" '\n\tstrevmld.,_-!aZ09éßя×÷½日\x1c\x85\u00a0\u2003\u3000\u200b"), max_size=40), max_size=4))
def test_random_marks_and_line_ends(texts):
    check_ids(texts)
    pieces, ends = words.pieces_of(packing.pa.array(texts, packing.pa.string()))
    pieces.validate(full=True)
    bounds = [0, *ends.tolist()]
    assert ["".join(pieces.to_pylist()[a:b]) for a, b in zip(bounds, bounds[1:])] == texts


def test_a_word_is_encoded_once_whatever_stands_behind_it():
    encoder, asked = packing.TokenIds(JSON), []
    for memory in (encoder.rest, encoder.first):
        memory.make = lambda parts, make=memory.make: asked.extend(parts) or make(parts)
    encoder.many(["a word, word. word\nNext word; word", "a naïveté, naïveté! (naïveté) word's\nNext"])
    assert sorted(asked) == sorted(["a", "word", ",", ".", "\nNext", ";", "naïveté", "!", "(naïveté", ")", "'s"])


def test_null_texts_and_bytes_that_are_no_text():
    raw = [b"a b, \xff c", None, b"\x80, x\xc3", b"", b"\xe2\x80 \xe3\x80\x80 a\xc3, b", "é, é".encode()]
    for given_rows in (raw, raw[3:]):
        ids, ends = IDS.joined(packing.as_texts(packing.pa.array([b"first", *given_rows], packing.pa.binary()).slice(1)))
        want = [whole((r or b"").decode("utf-8", "replace")) for r in given_rows]
        assert [part.tolist() for part in np.split(ids, ends)[:-1]] == want


def test_a_worker_keeps_its_encoder_for_its_next_tasks():
    held, asked = {"tokenizer": JSON}, []
    encoder = packing.kept_ids(held)
    make = encoder.rest.make
    encoder.rest.make = lambda parts: asked.extend(parts) or make(parts)
    want = encoder.many(["one two three two", "", "two"])
    assert sorted(asked) == ["three", "two"]
    assert packing.kept_ids(held) is encoder and encoder.many(["one two three two", "", "two"]) == want
    assert len(asked) == 2
    assert encoder.rest.results(["three", "new", "new", "two"]) == make(["three", "new", "new", "two"])
    assert asked[2:] == ["new"]


def test_results_of_a_full_memory():
    memory = words.Remembered(lambda parts: [p * 2 for p in parts], limit=500)
    for k in range(20):
        block = [f"{k}-{i}" for i in range(3)] + ["same", f"{k}-0"]
        assert memory.results(block) == [p * 2 for p in block]
    assert len(memory) < 20 and memory.results([]) == []


def test_a_full_memory_is_cleared_and_filled_again():
    memory = words.Remembered(lambda parts: [p * 2 for p in parts], limit=500)
    for k in range(20):
        block = [f"{k}-{i}" for i in range(3)] + ["same"]
        memory.learn(block)
        assert all(memory[p] == p * 2 for p in block)
    assert len(memory) < 20


def brute_least(lengths, capacity):
    """The least number of bins by trying everything."""
    best = len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                put(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
        put(i + 1, bins + [lengths[i]])

    put(0, [])
    return best


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [k for k in range(len(bins)) if bins[k] + n <= capacity]
        if fitting:
            bins[max(fitting, key=lambda k: bins[k])] += n
        else:
            bins.append(n)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=9))
def test_bound_and_packing_against_all_packings(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, count = packing.best_fit_decreasing(lengths, 24)
    bound = packing.lower_bound(lengths, 24)
    least = brute_least(lengths.tolist(), 24)
    assert bound <= least <= count
    filled = collections.Counter()
    for k, n in zip(bins.tolist(), lengths.tolist()):
        filled[k] += n
    assert sorted(filled.values()) == plain_best_fit(lengths.tolist(), 24)


def test_the_rounding_functions_see_what_sums_do_not():
    assert packing.lower_bound(np.array([7] * 6), 20) == 3  # the sum alone says 3, two fit
    assert packing.lower_bound(np.array([11] * 5), 20) == 5
    assert packing.lower_bound(np.array([11, 10, 10, 10]), 20) == 3


def check(rows, docs, capacity=2048):
    """rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    want = collections.Counter()
    for doc_id, text in docs:
        ids = np.array([*whole(text or ""), 0], "<u4")
        at = 0
        for k, n in enumerate(packing.piece_lengths(len(ids), capacity)):
            want[doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at += n
        assert at == len(ids)
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]
    rows = queries.op12_packing(spark, small).collect()
    used = check(rows, docs)
    total = sum(r.length for r in rows)
    assert -(-total // 2048) <= used <= -(-total // 2048) + 1


def test_odd_rows_and_clashing_names(spark):
    docs = [(1, None), (1, None), (None, ""), (2, "word " * 30000), (3, "x" * 9000), (4, "a b"), (4, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("offset", packing.F.lit("mine")).withColumn("extra", packing.F.col("doc_id"))
    rows = packing.pack(df, JSON, carry=["doc_id", "offset", "extra"]).collect()
    check(rows, docs)
    assert all(r.extra == r.doc_id for r in rows)
    assert packing.pack(df.limit(0), JSON).count() == 0


def items(spark, lengths):
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "_item long, length long")


def placed_bins(rows, capacity):
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.party, r.bin].append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


@pytest.mark.parametrize("seed", [1, 2])
def test_exchange_never_needs_more_and_certifies(spark, seed):
    lengths = np.random.default_rng(seed).integers(15, 50, 4000)
    first = packing.pack_items(items(spark, lengths), 100, per_partition=100, rounds=0).collect()
    rows = packing.pack_items(items(spark, lengths), 100, per_partition=100).collect()
    assert sorted(r._item for r in rows) == list(range(4000)) and [r.length for r in sorted(rows, key=lambda r: r._item)] == lengths.tolist()
    before, after = placed_bins(first, 100), placed_bins(rows, 100)
    assert packing.lower_bound(lengths, 100) <= after < before
    per_party = {r.party: (r.bins, r.bound) for r in rows}
    assert sum(b for b, _ in per_party.values()) == after and all(b >= low for b, low in per_party.values())


def test_one_length_held_by_most_pieces(spark):
    lengths = [700] * 3000 + [1300] * 100 + [48] * 3000
    rows = packing.pack_items(items(spark, lengths), 2048, per_partition=500).collect()
    assert placed_bins(rows, 2048) <= 1.02 * packing.lower_bound(np.array(lengths), 2048) + 2
