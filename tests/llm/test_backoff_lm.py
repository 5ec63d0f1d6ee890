import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from firstlook.llm import learning
from firstlook.llm.backoff_lm import END, Automaton, _grams, lm_scores

from .conftest import lower, words


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("order, block_bytes", [(1, 1 << 20), (2, 3_000), (3, 1 << 20)])
def test_equal_to_counting_by_hand(odd_docs, odd, order, block_bytes):
    weight = 2.5
    tokens = [(i, words(lower(t)) + [None]) for i, t in odd]
    counts = Counter()
    for i, w in tokens:
        if not is_held_out(i):
            for n in range(1, order + 1):
                counts.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    kinds = sum(len(g) == 1 for g in counts)

    def chance(before, word):
        if not before:
            return (counts[word,] + 1) / (total + kinds + 1)
        return (counts[*before, word] + weight * chance(before[1:], word)) / (counts[before] + weight)

    want = []
    for i, w in tokens:
        score = sum(math.log10(chance(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(len(w)))
        base = sum(math.log10((counts[x,] + 1) / (total + kinds + 1)) for x in w)
        want.append((str(i), is_held_out(i), len(w), sum(counts[x,] > 0 for x in w), total, round(base, 6), round(score, 6)))
    got = lm_scores(odd_docs, learning.held_out(F.col("doc_id"), 7, 2), order, weight, block_bytes).collect()
    assert sorted((str(r.doc_id), *r[1:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)


def test_probabilities_sum_to_one():
    tokens = np.array([5, 6, 5, 7, END, 6, 5, 6, END], np.uint64)
    grams = _grams(tokens, np.array([0, 5, 9]), 3)
    counts = [np.bincount(g.at[g.at >= 0], minlength=len(g.names)) for g in grams]
    automaton = Automaton(grams, counts, float(counts[0].sum() + len(counts[0]) + 1), 1.5)
    unknown = 1 / (counts[0].sum() + len(counts[0]) + 1)
    ends = np.concatenate([[False], *[grams[0].names[g.word] == END for g in grams[:2]]])
    for state in np.flatnonzero(~ends):  # nothing follows an end
        price, at = 0.0, state
        while at:
            price += automaton.fail_weight[at]
            at = automaton.fail[at]
        _, logs = automaton.step(np.full(automaton.words, state), np.arange(automaton.words))
        assert (10**logs).sum() + 10**price * unknown == pytest.approx(1)


def test_nothing_to_learn_from(odd_docs, odd):
    got = lm_scores(odd_docs, F.lit(True)).collect()
    assert len(got) == len(odd)
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score == 0 for r in got)


def test_no_rows(no_docs):
    assert lm_scores(no_docs, F.lit(False)).count() == 0
