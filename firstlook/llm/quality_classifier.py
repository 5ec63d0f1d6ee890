"""Quality scores by positive-unlabelled learning.

Only documents trusted to be good are labelled; all other text is an unlabelled mixture. A small network minimises the non-negative
unbiased risk: pi * R(positive as good) + max(0, R(unlabelled as bad) - pi * R(positive as bad)), where pi, the share of good text in
the mixture, is estimated from how the scores of trusted and unlabelled documents overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from . import learning
from .words import Texts, distinct, shingles_of, spans_print, texts_of, words_of

_KINDS = ("a-z", "A-Z", "0-9", " ", "\n", ".", ",", "!", "?", "|", "#", "$", "%", "&", "*", "<>", "@_/\\=+^~", "()[]{}", "'\"`:;-")


def _kind_of_byte() -> np.ndarray:
    kind = np.full(256, len(_KINDS) + 1)
    kind[:128] = len(_KINDS)
    for k, chars in enumerate(_KINDS):
        codes = range(ord(chars[0]), ord(chars[2]) + 1) if len(chars) == 3 and chars[1] == "-" else map(ord, chars)
        kind[list(codes)] = k
    return kind


_KIND = _kind_of_byte()
N_KINDS = len(_KINDS) + 2
SCORED_BYTES = 1 << 19


def features(texts: Texts) -> np.ndarray:
    """A row of shares and logarithms for each text: characters by kind, words, repetition and lines. Zeros for an empty text."""
    n, size = len(texts), np.diff(texts.bounds)
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    kinds = np.bincount(row * N_KINDS + _KIND[texts.data], minlength=n * N_KINDS).reshape(n, N_KINDS)
    words = words_of(texts)
    count = np.diff(words.bounds)
    share = lambda a, b: a / np.maximum(b, 1)
    by_row = lambda mask: np.bincount(words.row[mask], minlength=n)
    first, last = _KIND[texts.data[words.start]], _KIND[texts.data[words.end - 1]]
    upper = np.concatenate(([0], np.cumsum(_KIND[texts.data] == 1)))
    capital = upper[words.end] - upper[words.start]
    again = np.zeros(len(words.row), bool)
    again[1:] = (words.print[1:] == words.print[:-1]) & (words.row[1:] == words.row[:-1])
    u_row, _, u_times = distinct(words.row, words.print)
    t_row, _, t_times = distinct(*shingles_of(words, 3))
    breaks = np.flatnonzero(texts.data == 10)
    start = np.union1d(breaks + 1, texts.bounds[:-1])
    start = start[start < len(texts.data)]
    end = np.append(start[1:], len(texts.data))
    end -= (end > start) & (texts.data[end - 1] == 10)
    line_row = np.searchsorted(texts.bounds, start, "right") - 1
    filled = end > start
    l_row, _, l_times = distinct(line_row[filled], spans_print(texts.data, start[filled], end[filled]))
    lines = np.bincount(line_row[filled], minlength=n)
    log = np.log1p
    columns = [
        np.sqrt(share(kinds, size[:, None])),
        np.stack([
            log(count), share(size, count) / 10, share(by_row(capital == words.end - words.start), count),
            share(by_row((last >= 7) & (last <= 16)), count), share(by_row(first == 1), count), share(by_row(words.end - words.start == 1), count),
            np.sqrt(share(by_row(again), count)), share(np.bincount(u_row, minlength=n), count),
            share(np.bincount(u_row[u_times == 1], minlength=n), count),
            np.sqrt(share(np.bincount(t_row, weights=t_times * (t_times > 1), minlength=n), count)),
            np.sqrt(share(np.bincount(l_row, weights=l_times - 1, minlength=n), lines)), log(lines), log(share(size, lines)),
        ], axis=1),
    ]
    return np.concatenate(columns, axis=1)


@dataclass
class QualityModel:
    """Mean and deviation of the features, the layers of the network, and the estimated share of good text."""

    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return learning.sigmoid(_forward(np.clip((x - self.mean) / self.spread, -6, 6), self.layers)[1])


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, hidden @ layers[2] + layers[3][0]


def _backward(x: np.ndarray, hidden: np.ndarray, layers: list[np.ndarray], slope: np.ndarray) -> list[np.ndarray]:
    inner = np.outer(slope, layers[2]) * (1 - hidden * hidden)
    return [x.T @ inner, inner.sum(0), hidden.T @ slope, np.array([slope.sum()])]


def _layers(width: int, hidden: int) -> list[np.ndarray]:
    random = np.random.default_rng(5)
    return [random.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), random.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]


def _train(positive: np.ndarray, unlabelled: np.ndarray, hidden: int, steps: int, decay: float, slopes) -> list[np.ndarray]:
    x, n = np.concatenate([positive, unlabelled]), len(positive)

    def gradients(layers, _):
        inner, g = _forward(x, layers)
        found = _backward(x, inner, layers, slopes(g[:n], g[n:]))
        return [d + decay * layer for d, layer in zip(found, layers)]

    return learning.adam(_layers(x.shape[1], hidden), gradients, steps, 0.02)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of their tails above any score that half of the positives reach."""
    bars = np.quantile(positive, np.linspace(0.02, 0.5, 49))
    ratios = [(np.mean(unlabelled >= b) + 1 / len(unlabelled)) / np.mean(positive >= b) for b in bars]
    return float(np.clip(min(ratios), 0.05, 0.98))


def _prior(positive: np.ndarray, mixed: np.ndarray, decay: float) -> float:
    """The estimate from scores that a network gave to the half of the rows that it was not trained on."""

    def apart(gp, gu):
        return np.concatenate([-learning.sigmoid(-gp) / len(gp), learning.sigmoid(gu) / len(gu)])

    if min(len(positive), len(mixed)) < 2:
        return 0.5
    tails = []
    for k in (0, 1):
        net = _train(positive[k::2], mixed[k::2], 2, 100, decay, apart)
        tails.append((_forward(positive[1 - k :: 2], net)[1], _forward(mixed[1 - k :: 2], net)[1]))
    return float(np.mean([estimated_prior(*t) for t in tails]))


def fit_quality(
    docs: DataFrame, trusted: DataFrame, unlabelled: DataFrame, most: int = 6_000, hidden: int = 12, steps: int = 400, decay: float = 2.0,
) -> QualityModel:
    """Learn from ids of trusted and of unlabelled documents, at most ``most`` of each: those that hash lowest.

    The bound is the size of the driver's problem. Without trusted or without unlabelled documents, all scores are 0.5.
    """
    ids = learning.few(trusted.select("doc_id"), most, "trusted").withColumn("trusted", F.lit(1)).union(
        learning.few(unlabelled.select("doc_id"), most, "unlabelled").withColumn("trusted", F.lit(0))
    )

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch["text"]):
                yield pa.RecordBatch.from_pydict({
                    "trusted": batch["trusted"].slice(texts.first, len(texts)), "x": pa.array([r.tobytes() for r in features(texts)], pa.binary()),
                })

    rows = learning.with_texts(docs, ids).select("text", "trusted").mapInArrow(described, "trusted int, x binary").collect()
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(len(rows), -1)
    is_trusted = np.array([r.trusted for r in rows], bool)
    if is_trusted.all() or not is_trusted.any():
        width = N_KINDS + 13
        return QualityModel(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.zeros(1)], 0.5)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mean) / spread, -6, 6)
    positive, mixed = x[is_trusted], x[~is_trusted]
    n, m = len(positive), len(mixed)
    prior = _prior(positive, mixed, 10 / (n + m))

    def non_negative(gp, gu):
        p, u = learning.sigmoid(gp), learning.sigmoid(gu)
        as_good, as_bad_p, as_bad_u = prior * -p * (1 - p) / n, prior * p * (1 - p) / n, u * (1 - u) / m
        if u.mean() - prior * p.mean() < 0:  # the risk on bad text cannot be negative: step back instead of fitting further
            return np.concatenate([as_bad_p, -as_bad_u])
        return np.concatenate([as_good - as_bad_p, as_bad_u])

    return QualityModel(mean, spread, _train(positive, mixed, hidden, steps, decay / (n + m), non_negative), prior)


def score_quality(docs: DataFrame, model: QualityModel, into: str = "score") -> DataFrame:
    """docs with a column of scores: 0 to 1, higher for better text; from the column text alone.

    A row for each row, with its other columns, whatever its id; null and empty texts have the score of a text of no characters. A column
    with the name of the new one is replaced.
    """
    docs = docs.drop(into)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch["text"], SCORED_BYTES):
                yield batch.slice(texts.first, len(texts)).append_column(into, pa.array(model.score(features(texts))))

    schema = StructType([*docs.schema.fields])
    return docs.mapInArrow(score, schema.add(into, "double"))
