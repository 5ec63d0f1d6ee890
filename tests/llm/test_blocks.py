import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from firstlook.llm import blocks as B
from firstlook.llm.words import distinct, shingles_of, texts_of, words_of

from .conftest import lower, words

NUMBERS = st.lists(st.integers(0, 2**64 - 1), max_size=40)


@given(NUMBERS)
def test_numbers_survive_packing(values):
    values = np.array(values, np.uint64)
    assert (B.unpacked(B.packed(values)) == values).all()
    names = np.sort(values)
    assert (B.unpacked_names(B.packed_names(names)) == names).all()


@given(NUMBERS, st.integers(1, 9))
def test_questions_hold_every_name_once(values, buckets):
    names = np.unique(np.array(values, np.uint64))
    rows = B.questions(3, 0, names, np.arange(len(names)), buckets)
    back = np.concatenate([B.unpacked_names(r[3]) for r in rows] or [names])
    about = np.concatenate([B.unpacked(r[4]) for r in rows] or [names])
    assert (back == names).all() and about.tolist() == list(range(len(names)))
    assert all(0 <= r[0] < buckets and r[1:3] == (3, 0) for r in rows)


@settings(deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\n\x0b\x1f", max_size=30), max_size=8), st.integers(1, 40))
def test_words_and_shingles(texts, chunk_bytes):
    column = pa.array([t or None for t in texts], pa.string())
    seen, shingles = [], []
    for part in texts_of(column, chunk_bytes):
        found = words_of(part, lower=True)
        data = part.data.tobytes()
        seen += [(part.first + int(r), lower(data[a:b].decode())) for r, a, b in zip(found.row, found.start, found.end)]
        row, prints, times = distinct(*shingles_of(found, 2))
        shingles += [(part.first + int(r), int(p), int(t)) for r, p, t in zip(row, prints, times)]
    assert seen == [(k, lower(w)) for k, t in enumerate(texts) for w in words(t)]
    want = []
    for k, t in enumerate(texts):
        w = words(lower(t))
        pairs = list(zip(w, w[1:])) if len(w) > 1 else [tuple(w)] * bool(w)
        want += sorted((k, pairs.count(p)) for p in set(pairs))
    assert sorted((k, n) for k, _, n in shingles) == sorted(want)
    assert len({p for _, p, _ in shingles}) == len({p for t in texts for w in [words(lower(t))] for p in (zip(w, w[1:]) if len(w) > 1 else [tuple(w)] * bool(w))})


def test_blocks(odd_docs, odd, no_docs):
    rows, count = B.in_blocks(odd_docs, 2_000, rest=True)
    got = rows.collect()
    assert len(got) == len(odd) and count > 10 and all(0 <= r.block < count and r.rest.block == "b" for r in got)
    assert B.in_blocks(no_docs)[1] == 1
