"""Quality rules: counts that reject a document outright, and divergence from its language.

For each language the corpus itself gives two references: the shares of character classes and the shares of its commonest words. A
document is rejected when the Jensen-Shannon distance of its own shares from a reference is much larger than the median distance of
its language, which is above zero where the corpus itself holds much junk. Short documents, whose shares say little, are spared
by minimum lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from firstlook.plans.written import written

from .words import Texts, Words, shingles_of, spans_print, texts_of, words_of

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "#*$%&|<>", "!?")
_CLASS = np.full(256, len(_CLASSES) + 1)
_CLASS[:128] = len(_CLASSES)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k
N_CLASSES = len(_CLASSES) + 2
_SYMBOL = 7
WORD_BINS = 8_192
SMALL_LANGS = 2_000


def counts_of(texts: Texts, words: Words) -> dict[str, np.ndarray]:
    """The counts that need no reference, for each text."""
    n = len(texts)
    lead = (texts.data & 0xC0) != 0x80
    leads = np.concatenate(([0], np.cumsum(lead)))
    chars = leads[words.end] - leads[words.start]
    symbols = np.concatenate(([0], np.cumsum(_CLASS[texts.data] == _SYMBOL)))[texts.bounds]
    breaks = np.flatnonzero(texts.data == 10)
    start = np.union1d(breaks + 1, texts.bounds[:-1])
    start = start[start < len(texts.data)]
    end = np.append(start[1:], len(texts.data))
    end = end - ((end > start) & (texts.data[end - 1] == 10) & (np.searchsorted(breaks, end - 1, "left") < np.searchsorted(breaks, end, "left")))
    with_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[with_word], end[with_word]
    line_row = np.searchsorted(texts.bounds, start, "right") - 1
    seen = np.stack([line_row.astype(np.uint64), spans_print(texts.data, start, end)], axis=1)
    _, first = np.unique(seen, axis=0, return_index=True) if len(seen) else (None, np.zeros(0, int))
    again = np.ones(len(start), bool)
    again[first] = False
    return {
        "n_words": np.diff(words.bounds), "word_chars": np.bincount(words.row, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": np.diff(symbols), "n_dup_lines": np.bincount(line_row[again], minlength=n), "n_repeat_words": _repeat_words(words, n),
    }


def _repeat_words(words: Words, n: int) -> np.ndarray:
    """How many words are in a window of three words that occurs at least twice in the same text."""
    many = np.diff(words.bounds) >= 3
    inside = many[words.row]
    row, prints = words.row[inside], words.print[inside]
    if not len(row):
        return np.zeros(n, np.int64)
    w_row, w_print = shingles_of(Words(words.start[inside], words.end[inside], row, prints, np.searchsorted(row, np.arange(n + 1))), 3)
    at = np.flatnonzero(row[:-2] == row[2:])
    order = np.lexsort((w_print, w_row))
    same = (w_row[order][1:] == w_row[order][:-1]) & (w_print[order][1:] == w_print[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(row), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return np.bincount(row[covered], minlength=n)


def _shares(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Characters by class for each text, and each word's bin."""
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(texts.bounds))
    classes = np.bincount(row * N_CLASSES + _CLASS[texts.data], minlength=len(texts) * N_CLASSES).reshape(len(texts), N_CLASSES)
    return classes, (words.print % np.uint64(WORD_BINS)).astype(np.int64)


def failed(counts: dict[str, np.ndarray], min_words: int, repeat_percent: int) -> np.ndarray:
    return (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > repeat_percent * counts["n_words"])


def references(docs: DataFrame, common: int, min_words: int, repeat_percent: int) -> DataFrame:
    """(lang, class_bins, class_shares, word_bins, word_shares): a row for each language.

    The shares of character classes and of the commonest words, by fingerprint, over all the language's documents that pass the counts
    and have at most 2 symbols for every 100 characters in words.
    """

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for texts in texts_of(batch["text"]):
                words = words_of(texts, lower=True)
                classes, bins = _shares(texts, words)
                counts = counts_of(texts, words_of(texts))
                good = ~failed(counts, min_words, repeat_percent) & (100 * counts["n_symbols"] <= 2 * counts["word_chars"])
                langs = np.array(batch["lang"].slice(texts.first, len(texts)).to_pylist(), object)
                for lang in set(langs[good]):
                    mine = good & (langs == lang)
                    if lang is None:
                        mine = good & np.array([x is None for x in langs])
                    total = sums.setdefault(lang, np.zeros(N_CLASSES + WORD_BINS, np.int64))
                    total[:N_CLASSES] += classes[mine].sum(0)
                    total[N_CLASSES:] += np.bincount(bins[mine[words.row]], minlength=WORD_BINS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(at), pa.string()), "bin": pa.array(at.astype(np.int32)), "n": pa.array(total[at])
            })

    counted = docs.select("lang", "text").mapInArrow(histogram, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    by_lang = Window.partitionBy("lang")
    is_word = F.col("bin") >= N_CLASSES
    ranked = (
        counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang", is_word)))
        .withColumn("place", F.row_number().over(Window.partitionBy("lang", is_word).orderBy(F.desc("n"), "bin")))
        .filter(~is_word | (F.col("place") <= common)).withColumn("langs", F.count("*").over(by_lang))
    )
    listed = lambda keep: F.sort_array(F.collect_list(F.when(keep, F.struct("bin", "share"))))
    return ranked.groupBy("lang").agg(listed(~is_word).alias("c"), listed(is_word).alias("w")).select(
        "lang", F.col("c.bin").alias("class_bins"), F.col("c.share").alias("class_shares"),
        F.transform("w.bin", lambda b: b - N_CLASSES).alias("word_bins"), F.col("w.share").alias("word_shares"),
    )


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance in bits, 0 to 1, of each row of a from the shares b."""
    middle = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(a > 0, a * np.log2(a / middle), 0).sum(-1)
        right = np.where(b > 0, b * np.log2(b / middle), 0).sum(-1)
    return np.sqrt(np.maximum(0, (left + right) / 2))


def quality_rules(
    docs: DataFrame, min_words: int = 50, repeat_percent: int = 50, common: int = 64, class_margin: float = 0.15,
    word_margin: float = 0.235, min_chars: int = 200, min_common: int = 100,
) -> DataFrame:
    """Counts, distances and the verdict for every row of docs (doc_id, text, lang); other columns are ignored.

    base_failed: fewer than min_words words, or more than repeat_percent of them in repeated windows of three. kept: base passes, and
    neither distance is more than its margin above the median of its language (in steps of 0.001, of rows that pass base); the distance
    of classes counts from min_chars bytes on, that of words from min_common words on. Null texts count as empty and fail; a null lang is a language of its own. Distances are null where there is nothing to compare.
    """
    known = references(docs, common, min_words, repeat_percent)
    rows = _with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), known)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch["text"]):
                n = len(texts)
                counts = counts_of(texts, words_of(texts))
                base = failed(counts, min_words, repeat_percent)
                words = words_of(texts, lower=True)
                classes, bins = _shares(texts, words)
                by_class, by_word = np.full(n, np.nan), np.full(n, np.nan)
                langs = np.array([str(x) if x is not None else "\0" for x in batch["lang"].slice(texts.first, n).to_pylist()])
                for lang in np.unique(langs):
                    mine = np.flatnonzero(langs == lang)
                    told = {k: batch[k][texts.first + int(mine[0])].as_py() for k in ("class_bins", "class_shares", "word_bins", "word_shares")}
                    if told["class_bins"] is None:
                        continue
                    usual = np.zeros(N_CLASSES)
                    usual[told["class_bins"]] = told["class_shares"]
                    size = classes[mine].sum(1)
                    some = size > 0
                    by_class[mine[some]] = distance(classes[mine[some]] / size[some, None], usual)
                    place = np.full(WORD_BINS, len(told["word_bins"]))
                    place[told["word_bins"]] = np.arange(len(told["word_bins"]))
                    width = len(told["word_bins"]) + 1
                    of = np.full(n, -1)
                    of[mine] = np.arange(len(mine))
                    here = of[words.row] >= 0
                    found = np.bincount(of[words.row[here]] * width + place[bins[here]], minlength=len(mine) * width).reshape(-1, width)
                    total = found.sum(1)
                    some = total > 0
                    usual = np.append(told["word_shares"], 1 - sum(told["word_shares"]))
                    by_word[mine[some]] = distance(found[some] / total[some, None], np.maximum(usual, 0))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"].slice(texts.first, n), "lang": batch["lang"].slice(texts.first, n),
                    **{k: pa.array(v, pa.int64()) for k, v in counts.items()},
                    "base_failed": pa.array(base), "long_text": pa.array(np.diff(texts.bounds) >= min_chars),
                    "class_distance": pa.array(by_class, mask=np.isnan(by_class)), "word_distance": pa.array(by_word, mask=np.isnan(by_word)),
                })

    schema = f"doc_id long, lang string, {COUNTS}, base_failed boolean, long_text boolean, class_distance double, word_distance double"
    judged = written(rows.mapInArrow(judge, schema))
    judged = _with_language(judged, _medians(judged.filter("NOT base_failed"), ["class_distance", "word_distance"]))
    far = F.col("long_text") & (F.col("class_distance") > F.col("median_class_distance") + class_margin)
    far |= (F.col("n_words") >= min_common) & (F.col("word_distance") > F.col("median_word_distance") + word_margin)
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return judged.select("doc_id", *names, "base_failed", kept.alias("kept"), "class_distance", "word_distance")


def _with_language(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with what is known of their lang. Few languages, some 2 KB each, are broadcast; more are joined by shuffling."""
    known = written(known.withColumnRenamed("lang", "_lang"))
    side = F.broadcast(known) if known.count() <= SMALL_LANGS else known
    return rows.join(side, rows["lang"].eqNullSafe(known["_lang"]), "left").drop("_lang")


def _medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(lang, median_...): exact medians by language of columns cut to steps of 0.001, from counts of each step."""
    steps = rows.select("lang", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.floor(F.col(c) * 1000).alias("step")) for c in columns])).alias("v"))
    counts = steps.filter("v.step IS NOT NULL").groupBy("lang", "v.name", "v.step").agg(F.count("*").alias("n"))
    of = Window.partitionBy("lang", "name")
    reached = counts.withColumn("up_to", F.sum("n").over(of.orderBy("step"))).withColumn("all", F.sum("n").over(of)).filter("2 * up_to >= all")
    least = reached.groupBy("lang", "name").agg((F.min("step") / 1000).alias("median"))
    return least.groupBy("lang").agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(f"median_{c}") for c in columns])
