import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from firstlook.llm.packing import best_fit, cut, encoder, pack, pack_documents, plan, sequences

RANKS, JSON = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))


def plain_ids(text):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text, add_special_tokens=False).ids + [0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_both_libraries_give_the_same_ids(texts):
    assert encoder(RANKS)(texts) == encoder(JSON)(texts)


def test_special_strings_are_text():
    text = "a<|endoftext|>b"
    assert encoder(RANKS)([text]) == encoder(JSON)([text]) and 50256 not in encoder(RANKS)([text])[0]


@pytest.mark.parametrize("n, want", [(1, [(0, 1)]), (10, [(0, 10)]), (20, [(0, 10), (10, 10)]), (23, [(0, 3), (3, 10), (13, 10)])])
def test_only_longer_ones_are_cut(n, want):
    assert cut(n, 10) == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), max_size=12))
def test_plan_uses_each_length_as_often_as_it_occurs(lengths):
    histogram = np.zeros(41, np.int64)
    for n, c in lengths.items():
        histogram[n] = c
    for made in (plan(histogram, 40), best_fit(histogram.copy(), 40)):
        used = np.zeros(41, np.int64)
        for runs, times in made:
            assert times > 0 and sum(n * m for n, m in runs) <= 40
            for n, m in runs:
                used[n] += m * times
        assert (used == histogram).all()


@pytest.mark.parametrize("seed", range(4))
def test_plan_needs_no_more_than_best_fit_alone(seed):
    histogram = np.random.default_rng(seed).integers(0, 30, 257)
    histogram[0] = 0
    assert sum(times for _, times in plan(histogram, 256)) <= sum(times for _, times in best_fit(histogram.copy(), 256)) * 1.002


def test_plan_is_close_to_the_least_possible_for_many_short_pieces():
    histogram = np.random.default_rng(0).poisson(4000 / np.arange(1, 258))
    histogram[0] = 0
    least = -(-int((histogram * np.arange(257)).sum()) // 256)
    assert sum(times for _, times in plan(histogram, 256)) <= least + 1


def test_documents(odd_docs, odd):
    packed = pack_documents(odd_docs, RANKS, 64, keep_ids=True).persist()
    rows = packed.collect()
    want = []
    for i, text in odd:
        ids = plain_ids(text)
        want += [(str(i), k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cut(len(ids), 64))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for filled in places.values():
        at = 0
        for offset, length in sorted(filled):
            assert offset == at
            at += length
        assert at <= 64
    whole = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in rows)
    assert len(places) <= -(-sum(r.length for r in rows) // 64) + 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " "])), max_size=6).map("".join), max_size=5))
def test_both_libraries_know_special_tokens(texts):
    default = Tokenizer.from_file(JSON)
    want = [default.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder(RANKS, special=True)(texts) == want and encoder(JSON, special=True)(texts) == want


@pytest.mark.parametrize("path", [RANKS, JSON])
def test_documents_with_special_tokens(spark, path):
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|><|endoftext|> c"]
    default = Tokenizer.from_file(JSON)
    packed = pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, keep_ids=True)
    got = {r.doc_id: r.ids for r in packed.collect()}
    assert got == {k: default.encode(t, add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}


def test_no_rows(no_docs):
    assert pack_documents(no_docs, RANKS).count() == 0


def test_columns_of_any_name_survive_packing(spark):
    rows = [(k, 1 + k % 7, "p", "r", -1, -2) for k in range(40)]
    lengths = spark.createDataFrame(rows, "id long, length long, _part string, _rank string, offset long, sequence_id long")
    got = pack(lengths, 10, ["id"]).collect()
    assert len(got) == 40 and {(r["_part"], r["_rank"]) for r in got} == {("p", "r")}
    assert all(r["sequence_id"] >= 0 and 0 <= r["offset"] <= 10 - r["length"] for r in got)
