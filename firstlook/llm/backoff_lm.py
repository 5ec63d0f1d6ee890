"""Scores of texts under an n-gram model, as a weighted backoff automaton.

n-grams are smoothed towards shorter ones: p(w | h) = (c(h w) + m * p(w | h')) / (c(h) + m), where h' is h without its first word, and
p(w) = (c(w) + 1) / (N + V + 1). Each n-gram that can be continued is a state. A word has an arc from a state if the longer n-gram
was seen in training; else the failure arc leads to the state of h', at the price m / (c(h) + m). A text is read once from left to right;
its state and the sum of logarithms are all that is carried. Counts cover the whole training corpus. Every block of documents has
the part of the automaton that its own words can reach, by asking the corpus for the counts of its n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks as B
from .words import chain, texts_of, words_of

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END = np.uint64(0x5F656E645F746578)
LANE = 512


@dataclass
class Grams:
    """A block's distinct n-grams of one order, with fingerprints in the order of ids.

    at: each token's n-gram that ends there, or -1. For each n-gram: its fingerprint, its first n - 1 words as an id of the order below,
    its last word, and its last n - 1 words as an id of the order below.
    """

    at: np.ndarray
    names: np.ndarray
    parent: np.ndarray
    word: np.ndarray
    suffix: np.ndarray


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows' words and ends as fingerprints, and each row's range."""
    parts, sizes = [], []
    for _, column in B.texts_in(table):
        for texts in texts_of(column):
            words = words_of(texts, lower=True)
            parts.append(np.insert(words.print, words.bounds[1:], END))
            sizes.append(np.diff(words.bounds) + 1)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def _grams(tokens: np.ndarray, bounds: np.ndarray, order: int) -> list[Grams]:
    names, at = np.unique(tokens, return_inverse=True)
    empty = np.zeros(len(names), np.int64)
    found = [Grams(at, names, empty, np.arange(len(names)), empty)]
    for n in range(2, order + 1):
        low = found[-1]
        ok = np.ones(len(tokens), bool)
        ok[bounds[:-1]] = False
        ok[1:] &= low.at[:-1] >= 0
        where = np.flatnonzero(ok)
        key = low.at[where - 1] * len(names) + at[where]
        keys, first, of = np.unique(key, return_index=True, return_inverse=True)
        parent, word = keys // len(names), keys % len(names)
        ids = np.full(len(tokens), -1)
        ids[where] = of
        suffix = low.at[where[first]] if n > 2 else word
        found.append(Grams(ids, chain([low.names[parent], names[word]]), parent, word, suffix))
    return found


class Automaton:
    """States and arcs among a block's n-grams. State 0 is the empty context; then come the n-grams of each order below the highest."""

    def __init__(self, grams: list[Grams], counts: list[np.ndarray], total: float, weight: float) -> None:
        self.words = len(grams[0].names)
        starts = np.cumsum([1] + [len(g.names) for g in grams[:-1]])
        last = len(grams)
        chance = (counts[0] + 1) / total
        self.root_weight = np.log10(chance)
        goes_on = (counts[0] > 0) & (grams[0].names != END)
        self.root_next = np.where(goes_on, starts[0] + np.arange(self.words), 0) if last > 1 else np.zeros(self.words, np.int64)
        self.fail = np.zeros(int(starts[-1]), np.int64)
        self.fail_weight = np.zeros(int(starts[-1]))
        keys, weights, nexts, onward = [], [], [], self.root_next
        for n in range(2, last + 1):
            low, high = grams[n - 2], grams[n - 1]
            states = slice(starts[n - 2], starts[n - 2] + len(low.names))
            self.fail[states] = starts[n - 3] + low.suffix if n > 2 else 0
            self.fail_weight[states] = np.log10(weight / (counts[n - 2] + weight))
            chance = (counts[n - 1] + weight * chance[high.suffix]) / (counts[n - 2][high.parent] + weight)
            seen = counts[n - 1] > 0
            if n < last:
                target = np.where(grams[0].names[high.word] != END, starts[n - 1] + np.arange(len(high.names)), 0)
            else:
                target = onward[high.suffix]
            keys.append(((starts[n - 2] + high.parent) * self.words + high.word)[seen])
            weights.append(np.log10(chance[seen]))
            nexts.append(target[seen])
            onward = np.where(seen, target, onward[high.suffix])
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.weight = np.concatenate(weights)[order] if weights else np.zeros(0)
        self.next = np.concatenate(nexts)[order] if nexts else np.zeros(0, np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the log-probabilities of reading a word in each state."""
        cost = np.zeros(len(state))
        after = np.zeros(len(state), np.int64)
        open_ = np.flatnonzero(state > 0)
        state = state.copy()
        while len(open_):
            key = state[open_] * self.words + word[open_]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            done = open_[hit]
            cost[done] += self.weight[at[hit]]
            after[done] = self.next[at[hit]]
            state[done] = -1
            open_ = open_[~hit]
            cost[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail[state[open_]]
            open_ = open_[state[open_] > 0]
        root = np.flatnonzero(state == 0)
        cost[root] += self.root_weight[word[root]]
        after[root] = self.root_next[word[root]]
        return after, cost

    def read(self, words: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
        """The sum of log-probabilities of each row's words.

        Rows are read side by side, in lanes of bounded length. A state depends on the last order - 1 words alone, so a lane that begins
        inside a row first reads so many words before its own, without counting them.
        """
        lengths = np.diff(bounds)
        lanes = -(-lengths // LANE)
        row = np.repeat(np.arange(len(lengths)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        own = bounds[row] + nth * LANE
        begin = np.where(nth > 0, own - (order - 1), own)
        end = np.minimum(own + LANE, bounds[row + 1])
        by_length = np.argsort(begin - end, kind="stable")
        row, own, begin, end = row[by_length], own[by_length], begin[by_length], end[by_length]
        length = end - begin
        state, total = np.zeros(len(row), np.int64), np.zeros(len(row))
        for t in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -t, "left"))
            at = begin[:active] + t
            state[:active], cost = self.step(state[:active], words[at])
            total[:active] += np.where(at >= own[:active], cost, 0)
        return np.bincount(row, weights=total, minlength=len(lengths))


def lm_scores(docs: DataFrame, held_out: Column, order: int = 2, weight: float = 64.0, block_bytes: int = 2 * B.BLOCK_BYTES) -> DataFrame:
    """Each row's counts and log10 probabilities: under single words with one added to each count, and under the automaton.

    Takes doc_id and text; held_out is a condition on doc_id that keeps a row out of training. A null or empty text is its end alone. Rows
    with a null condition are trained on. Repeated rows count as often as they occur; other columns are ignored. An empty table
    gives no rows; without training rows every word is unknown. order is the longest n-gram; weight is m of the smoothing.
    """
    rows, count = B.in_blocks(docs, block_bytes)
    rows = rows.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    buckets = B.buckets_for(count, 0.11 * order, block_bytes)

    def asking(table: pa.Table) -> list[tuple]:
        tokens, bounds = _tokens(table)
        train = np.repeat(~table["held_out"].to_numpy(), np.diff(bounds))
        block, asked = table["block"][0].as_py(), []
        for n, grams in enumerate(_grams(tokens, bounds, order)):
            here = train & (grams.at >= 0)
            times = np.bincount(grams.at[here], minlength=len(grams.names))
            by_name = np.argsort(grams.names)
            asked += B.questions(block, n, grams.names[by_name], times[by_name], buckets, all_buckets=True)
        return asked

    def answering(table: pa.Table) -> list[tuple]:
        bucket, given = table["bucket"][0].as_py(), []
        kinds, block = table["kind"].to_numpy(), table["block"].to_numpy()
        for n in range(order):
            mine = np.flatnonzero(kinds == n)
            lists = [B.unpacked_names(table["names"][int(k)].as_py()) for k in mine]
            names, of = np.unique(np.concatenate(lists), return_inverse=True)
            times = np.bincount(of, weights=np.concatenate([B.unpacked(table["extra"][int(k)].as_py()) for k in mine]), minlength=len(names))
            totals = [int(times.sum()), int((times > 0).sum())] if n == 0 else [0, 0]
            edges = np.cumsum([0] + [len(x) for x in lists])
            for k, a, b in zip(mine, edges, edges[1:]):
                given.append((int(block[k]), bucket, n, B.packed(np.concatenate([totals, times[of[a:b]]]).astype(np.int64))))
        return given

    def using(table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, bounds = _tokens(table)
        grams = _grams(tokens, bounds, order)
        counts, known = [np.zeros(len(g.names), np.int64) for g in grams], [0, 0]
        by_name = [np.argsort(g.names) for g in grams]
        edges = [B.bucket_edges(g.names[o], buckets) for g, o in zip(grams, by_name)]
        for bucket, n, data in zip(answers["bucket"].to_pylist(), answers["kind"].to_pylist(), answers["answer"].to_pylist()):
            values = B.unpacked(data)
            known = [known[0] + int(values[0]), known[1] + int(values[1])]
            counts[n][by_name[n][edges[n][bucket] : edges[n][bucket + 1]]] = values[2:]
        total = float(known[0] + known[1] + 1)
        row = np.repeat(np.arange(len(table)), np.diff(bounds))
        of_token = counts[0][grams[0].at]
        base = np.bincount(row, weights=np.log10((of_token + 1) / total), minlength=len(table))
        score = Automaton(grams, counts, total, weight).read(grams[0].at, bounds, order)
        return pa.table({
            "doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": pa.array(np.diff(bounds)),
            "n_known": pa.array(np.bincount(row[of_token > 0], minlength=len(table))), "train_tokens": pa.array([known[0]] * len(table), pa.int64()),
            "base_score": pa.array(base), "score": pa.array(score),
        })

    return B.told(rows, B.answer(B.ask(rows, asking), answering), using, SCORES)
