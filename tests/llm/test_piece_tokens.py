import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from firstlook.llm.piece_tokens import Pieces, _stream, decode_ids, encode_texts, piece_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def best_score(pieces: dict[bytes, float], byte_score: float, text: str) -> float:
    """The best segmentation's score, by trying every piece at every position."""
    data = (" " + text).encode() if text else b""
    best = [0.0] + [-np.inf] * len(data)
    for end in range(1, len(data) + 1):
        best[end] = best[end - 1] + byte_score
        for start in range(max(0, end - 48), end):
            if data[start:end] in pieces:
                best[end] = max(best[end], best[start] + pieces[data[start:end]])
    return best[-1]


@pytest.fixture(scope="module")
def plain():
    p = Pieces.load(MODEL)
    return {p.bytes[s : s + n].tobytes(): v for s, n, v in zip(p.start, p.length, p.score) if n and v != p.byte_score}, p.byte_score


def encoded(texts):
    pieces = Pieces.load(MODEL)
    data = [t.encode() for t in texts]
    stream, bounds = _stream(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))
    ids, edges = pieces.encode(stream, bounds)
    return pieces, ids, edges


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="the anditr▁ \n", max_size=60)), max_size=6))
def test_best_score_and_round_trip(plain, texts):
    pieces, ids, edges = encoded(texts)
    data, bounds = pieces.decode(ids, edges)
    for k, text in enumerate(texts):
        assert pieces.score[ids[edges[k] : edges[k + 1]]].sum() == pytest.approx(best_score(*plain, text))
        assert data[bounds[k] : bounds[k + 1]].tobytes() == ((" " + text).encode() if text else b"")


def test_a_vocabulary_whose_pieces_reach_over_words():
    pieces = Pieces([(0, b" a", -1.0), (1, b"a b", -1.5), (2, b" ", -3.0), (3, b"a", -3.0), (4, b"b", -3.0), (5, b" b", -4.0)], np.arange(6, 262), 262)
    assert not pieces.by_words
    ids, _ = pieces.encode(np.frombuffer(b" a b", np.uint8), np.array([0, 4]))
    assert ids.tolist() == [2, 1]  # -4.5, better than -5 for " a" and " b"


def test_odd_rows(odd_docs, odd, no_docs):
    again = decode_ids(encode_texts(odd_docs, MODEL), MODEL)
    assert Counter(map(tuple, again.collect())) == Counter(odd)
    counts = piece_counts(odd_docs, MODEL).collect()
    assert all(r.round_trip for r in counts) and len(counts) == len(odd)
    assert sum(r.n_ids == 0 for r in counts) == sum(t == "" for _, t in odd)
    assert piece_counts(no_docs, MODEL).count() == 0 and decode_ids(encode_texts(no_docs, MODEL), MODEL).count() == 0


def own_ids(texts):
    pieces = Pieces.load(MODEL)
    data = [t.encode() for t in texts]
    stream, bounds = _stream(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))
    ids, edges = pieces.encode(stream, bounds, own=True)
    return [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(
    st.text(st.characters(codec="utf-8", exclude_characters="▁"), max_size=40), st.text(alphabet="thes anditrlo\n", max_size=80), st.text(alphabet=" a", max_size=30),
), max_size=6))
def test_ids_are_those_of_sentencepiece(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert own_ids(texts) == [model.encode(t) for t in texts]


def test_documents_have_the_ids_of_sentencepiece(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: model.encode(r.text) for r in rows if "▁" not in r.text}
    got = {r.doc_id: r.ids for r in encode_texts(docs, MODEL).collect()}
    assert want and all(got[i] == ids for i, ids in want.items())
    crc = {r.doc_id: r.ids_crc32 for r in piece_counts(docs, MODEL).collect()}
    assert all(crc[i] == zlib.crc32(np.array(ids, "<u4").tobytes()) for i, ids in want.items())
