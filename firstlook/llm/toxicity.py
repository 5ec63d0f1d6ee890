"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is a logistic function of the words and word beginnings in it, each counted once; a document's is the noisy-or of its sentences, 1 - prod(1 - p).
Training maximises the likelihood of the documents' labels, so the blame settles on the sentences that tell toxic documents from others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firstlook.plans.written import written

from . import learning
from .words import Texts, distinct, lowered, mix, spans_print, texts_of, words_of

SCORES = "doc_id long, score double, n_sentences long, worst_start long, worst_end long, worst_score double"
_GAP = np.ones(256, bool)
_GAP[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), ord("'"), *range(0x80, 256)]] = False
_BEGINNINGS = (5, 6, 7, 8)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class ToxicityModel:
    """Weights of words, by fingerprint in ascending order, and the score of a sentence without any of them."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def _sentences(texts: Texts):
    """Features with the row and sentence of each, and each sentence's row and byte span; an empty row has none.

    Features are the fingerprints of words and of their first 5 to 8 bytes, where a word is longer.
    """
    words = words_of(texts, lower=True, gap=_GAP)
    data, length = lowered(texts.data), words.end - words.start
    prints, rows, starts = [words.print], [words.row], [words.start]
    for size in _BEGINNINGS:
        longer = length > size
        prints.append(mix(spans_print(data, words.start[longer], words.start[longer] + size) + np.uint64(size)))
        rows.append(words.row[longer])
        starts.append(words.start[longer])
    prints, rows, starts = (np.concatenate(x) for x in (prints, rows, starts))
    stops = np.flatnonzero(_STOP[texts.data]) + 1
    edges = np.union1d(stops, texts.bounds[:-1])
    edges = edges[edges < len(texts.data)]
    row = np.searchsorted(texts.bounds, edges, "right") - 1
    end = np.append(edges[1:], len(texts.data))
    empty = np.flatnonzero(np.diff(texts.bounds) == 0)
    return prints, rows, np.searchsorted(edges, starts, "right") - 1, row, edges, end, empty


def _distinct(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, sentence, feature), each once, in this order."""
    prints, rows, sentence, *_ = _sentences(texts)
    order = np.lexsort((prints, sentence, rows))
    prints, rows, sentence = prints[order], rows[order], sentence[order]
    new = np.ones(len(rows), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (prints[1:] != prints[:-1])
    return rows[new], sentence[new], prints[new]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, label) for each feature of each document, once."""
    for batch in batches:
        labels = batch["label"].to_numpy()
        for texts in texts_of(batch["text"]):
            rows, _, prints = _distinct(texts)
            rows, prints, _ = distinct(rows, prints)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(prints.view(np.int64)), "label": pa.array(labels[texts.first + rows], pa.int32())})


def _bags(vocabulary: np.ndarray):
    """Each document's label and its sentences' features, among those of an ascending vocabulary."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch["text"]):
                rows, sentence, prints = _distinct(texts)
                at = np.minimum(np.searchsorted(vocabulary, prints), len(vocabulary) - 1)
                known = vocabulary[at] == prints
                rows, sentence, at = rows[known], sentence[known], at[known].astype(np.int32)
                edges = np.searchsorted(rows, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_pydict({
                    "label": batch["label"].slice(texts.first, len(texts)),
                    "words": pa.array([at[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                    "sentences": pa.array([sentence[a:b].astype(np.int32).tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                })

    return bags


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, most: int = 3_000, min_docs: int = 4, min_odds: float = 1.5,
    steps: int = 300, rate: float = 0.1, ridge: float = 1e-5,
) -> ToxicityModel:
    """Learn from labelled documents: docs (doc_id, text), labels (doc_id, label 0 or 1).

    At most ``most`` documents of each label are used, those whose ids hash lowest; this bounds the sample, which is written once, and the
    driver's problem.
    Words and beginnings get a weight only if
    they are in min_docs toxic documents and the log-odds ratio of toxic to clean documents is above min_odds. Weights are never
    negative: no word excuses another one. Without documents of
    both labels no word has a weight, and all scores are near the share of toxic ones.
    """
    ids = learning.few(labels.filter("label = 1"), most, "toxic").union(learning.few(labels.filter("label = 0"), most, "clean"))
    sample = written(learning.with_texts(docs, ids).select("text", "label"))
    counted = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counted.get(1, 0), counted.get(0, 0)
    if not n_toxic or not n_clean:
        p = 0.99 if n_toxic else 0.01
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p))))
    spread = sample.mapInArrow(_spread, "feature long, label int").groupBy("feature").agg(F.sum("label").alias("toxic"), F.count("*").alias("all"))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("all") - F.col("toxic") + 0.5)) - float(np.log((n_toxic + 1) / (n_clean + 1)))
    useful = spread.select("feature", "toxic", odds.alias("odds")).filter((F.col("toxic") >= min_docs) & (F.col("odds") > min_odds)).collect()
    if not useful:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -6.0)
    vocabulary = np.array([r.feature for r in useful], np.int64).view(np.uint64)
    by_print = np.argsort(vocabulary)
    vocabulary, odds = vocabulary[by_print], np.array([r.odds for r in useful])[by_print]
    rows = sample.mapInArrow(_bags(vocabulary), "label int, words binary, sentences binary").collect()
    y = np.array([r.label for r in rows], float)
    words = [np.frombuffer(r.words, np.int32) for r in rows]
    bag_doc = np.repeat(np.arange(len(rows)), [len(w) for w in words])
    word = np.concatenate(words)
    bag = np.concatenate([np.frombuffer(r.sentences, np.int32) for r in rows]) + (bag_doc << 32)
    bags, bag = np.unique(bag, return_inverse=True)
    owner = np.zeros(len(bags), np.int64)
    owner[bag] = bag_doc
    importance = np.full(len(y), 1 / len(y))

    def gradients(now, _):
        weights, bias = now
        p = learning.sigmoid(np.bincount(bag, weights=weights[word], minlength=len(bags)) + bias[0])
        clean = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        whole = np.clip(1 - np.exp(clean), 1e-9, 1 - 1e-9)
        # d loss / d log(1 - p_document), then through log(1 - p_sentence) to each sentence's logit
        d_clean = importance * np.where(y > 0, np.exp(clean) / whole, -1.0)
        d_bag = -p * d_clean[owner]
        return np.bincount(word, weights=d_bag[bag], minlength=len(vocabulary)) + ridge * weights, np.array([d_bag.sum()])

    def bounded(now):
        np.maximum(now[0], 0, out=now[0])
        np.clip(now[1], -12, -4, out=now[1])

    weights, bias = learning.adam([odds / 2, np.array([-6.0])], gradients, steps, rate, bounded)
    kept = weights > 0.05
    return ToxicityModel(vocabulary[kept], weights[kept], float(bias[0]))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Each document's probability, its number of sentences, and the byte span and score of the worst sentence.

    Takes doc_id and text, ignoring other columns; a row for each row, whatever its id. A null or empty text has no sentence and the
    score of one without any known word. Sentences end after ``.``, ``!``, ``?`` or a line break; ties go to the first.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch["text"]):
                n = len(texts)
                prints, _, sentence, row, start, end, empty = _sentences(texts)
                total = np.full(len(start), model.bias)
                if len(model.words) and len(prints):
                    at = np.minimum(np.searchsorted(model.words, prints), len(model.words) - 1)
                    known = np.flatnonzero(model.words[at] == prints)
                    said = np.unique(sentence[known] * len(model.words) + at[known])
                    total += np.bincount(said // len(model.words), weights=model.weights[said % len(model.words)], minlength=len(start))
                p = learning.sigmoid(total)
                # A sentence without known words says nothing; else long clean texts would add up to toxic ones.
                base = learning.sigmoid(np.array([model.bias]))[0]
                said = total > model.bias
                rest = np.bincount(row[said], weights=np.log1p(-np.minimum(p[said], 1 - 1e-12)), minlength=n)
                whole = 1 - (1 - base) * np.exp(rest)
                order = np.lexsort((start, -p, row))
                first = np.searchsorted(row[order], np.arange(n))
                has = np.ones(n, bool)
                has[empty] = False
                worst = order[np.minimum(first, max(len(order) - 1, 0))] if len(order) else np.zeros(n, np.int64)
                pick = lambda values: pa.array(values[worst] if len(order) else np.zeros(n, values.dtype), mask=~has)
                at_row = texts.bounds[:-1]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"].slice(texts.first, n), "score": pa.array(whole),
                    "n_sentences": pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                    "worst_start": pa.array((start[worst] if len(order) else np.zeros(n, np.int64)) - at_row, pa.int64(), mask=~has),
                    "worst_end": pa.array((end[worst] if len(order) else np.zeros(n, np.int64)) - at_row, pa.int64(), mask=~has),
                    "worst_score": pick(p),
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, SCORES)
