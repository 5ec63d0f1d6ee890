"""Maximal periodic runs of words in each document, by recompression.

The words of some documents, with a mark of its own at each end of a document, become a run-length grammar: by turns, neighbours that are equal
are compressed to one block (symbol, count), and neighbours of which the first is in the left and the second in the right class to one pair,
with classes drawn by the symbol's name, until each document is one symbol. Equal stretches are parsed alike but for their edges, so
the longest common extension of two places is found on a walk up the levels, as long as both sides agree, and down again to the first
word that differs. Walks of all questions go on together, level by level; the mirrored grammar answers to the left.

Candidates are on harmonic grids: a run of period p and at least 3 * p words holds three places k * p next to each other, so for each p only the
places k * p of a document are looked at, n / p of them, and only those with equal words where a run demands it are extended.
A run is told by its two ends, and the least period that leads to them is its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .words import Texts, mix, ranges, texts_of, words_of

CHUNK_BYTES = 512 << 10
#: So many grid places are looked at together.
GRID = 1 << 18
TIMES = 3
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"


@dataclass
class Level:
    """Symbols of one level and how the next one groups them: symbol k is in group up[k], group g begins at first[g]."""

    symbol: np.ndarray
    up: np.ndarray
    first: np.ndarray
    blocks: bool

    def mirrored(self) -> "Level":
        count = len(self.symbol)
        return Level(self.symbol[::-1], (len(self.first) - 2 - self.up)[::-1], (count - self.first)[::-1], self.blocks)


def _level(symbol: np.ndarray, begins: np.ndarray, blocks: bool) -> Level:
    first = np.append(np.flatnonzero(begins), len(symbol)).astype(np.int32)
    return Level(symbol, (np.cumsum(begins) - 1).astype(np.int32), first, blocks)


def grammar(symbol: np.ndarray, marks: int) -> list[Level]:
    """The levels over symbols of which those below marks occur once each and never join a group; the last one is not grouped."""
    levels, names, turn = [], int(symbol.max()) + 1, 0
    symbol = symbol.astype(np.int32)
    while True:
        same = symbol[1:] == symbol[:-1]
        if same.any():
            level = _level(symbol, np.concatenate(([True], ~same)), True)
            size = np.diff(level.first)
            after, many = symbol[level.first[:-1]].copy(), size > 1
            named, name = np.unique(after[many].astype(np.int64) * (int(size.max()) + 1) + size[many], return_inverse=True)
            after[many], names = names + name, names + len(named)
            levels.append(level)
            symbol = after
        word = symbol >= marks
        if not (word[1:] & word[:-1]).any():
            return [*levels, Level(symbol, np.zeros(0, np.int32), np.zeros(0, np.int32), False)]
        turn += 1
        left = mix(symbol.astype(np.uint64) + np.uint64(turn << 40)) >> np.uint64(63) == 0
        pair = left[:-1] & ~left[1:] & word[:-1] & word[1:]
        if pair.any():
            level = _level(symbol, np.concatenate(([True], ~pair)), False)
            at = np.flatnonzero(pair)
            named, name = np.unique(symbol[at].astype(np.int64) * names + symbol[at + 1], return_inverse=True)
            after = symbol[level.first[:-1]].copy()
            after[level.up[at]], names = names + name, names + len(named)
            levels.append(level)
            symbol = after


def _rest(level: Level, at: np.ndarray) -> np.ndarray:
    """How many equal symbols there are from a place to the end of its group."""
    return level.first[level.up[at] + 1] - at if level.blocks else np.ones(len(at), np.int32)


def extension(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from places a and b on are equal, pair by pair; a and b differ and lie in one document or on its mark."""
    found, n = np.zeros(len(a), np.int64), len(a)
    x, y, who = a.astype(np.int32), b.astype(np.int32), np.arange(n)
    stop, ends = np.zeros(n, np.int32), [np.zeros(n, np.int32), np.zeros(n, np.int32)]

    def halt(some: np.ndarray, k: int) -> None:
        stop[who[some]], ends[0][who[some]], ends[1][who[some]] = k, x[some], y[some]

    for k, level in enumerate(levels):
        differ = level.symbol[x] != level.symbol[y]
        halt(differ, k)
        x, y, who = x[~differ], y[~differ], who[~differ]
        if not len(who):
            break
        inside = (level.first[level.up[x]] != x) | (level.first[level.up[y]] != y)
        rest_x, rest_y = _rest(level, x), _rest(level, y)
        step = np.where(inside, np.minimum(rest_x, rest_y), 0)
        x, y = x + step, y + step
        halt(odd := inside & (rest_x != rest_y), k)
        x, y, who = level.up[x[~odd]], level.up[y[~odd]], who[~odd]

    order = np.argsort(-stop, kind="stable")
    heights, (x, y) = -stop[order], (e[order] for e in ends)
    for k in range(int(stop.max(initial=0)) - 1, -1, -1):
        higher, level = int(np.searchsorted(heights, -k, "left")), levels[k]
        down_x, down_y = level.first[x[:higher]], level.first[y[:higher]]
        step = np.where(level.symbol[down_x] == level.symbol[down_y], np.minimum(_rest(level, down_x), _rest(level, down_y)), 0)
        x[:higher], y[:higher] = down_x + step, down_y + step
    found[order] = x - a[order]
    return found


def _grids(start: np.ndarray, count: np.ndarray, min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid places with two more after them, for documents that begin at start; some at a time."""
    long = count >= max(min_length, TIMES)
    start, count = start[long], count[long]
    most = count // TIMES
    doc = np.repeat(np.arange(len(count)), most)
    period = ranges(np.ones(len(count), np.int64), most)
    places = (count[doc] - 1) // period - 1
    pieces = -(-places // GRID)  # the places of one document and period, if they are very many, in several pieces
    doc, period, piece = np.repeat(doc, pieces), np.repeat(period, pieces), ranges(np.zeros(len(pieces), np.int64), pieces)
    size = np.minimum(np.repeat(places, pieces) - piece * GRID, GRID)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + GRID, "right")))
        own = slice(at, end)
        step = np.repeat(period[own], size[own])
        yield np.repeat(start[doc[own]], size[own]) + step * ranges(piece[own] * GRID, size[own]), step
        at = end


def runs_of(prints: np.ndarray, bounds: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs of at least min_length words and three periods, by start and period, for documents of words."""
    docs = len(bounds) - 1
    count = np.diff(bounds)
    place = bounds[:-1] + np.arange(1, docs + 1)  # a mark before each document, and one at the end
    symbol = np.empty(len(prints) + docs + 1, np.int64)
    symbol[np.append(place - 1, len(symbol) - 1)] = np.arange(docs + 1)
    symbol[ranges(place, count)] = np.unique(prints, return_inverse=True)[1] + docs + 1
    levels = mirror = None
    runs = np.zeros((3, 0), np.int64)
    for at, period in _grids(place, count, min_length):
        half = at + period // 2
        likely = (symbol[at] == symbol[at + period]) & (symbol[half] == symbol[half + period]) & (symbol[at + period] == symbol[at + 2 * period])
        at, period = at[likely], period[likely]
        if not len(at):
            continue
        if levels is None:
            levels = grammar(symbol, docs + 1)
            mirror = [level.mirrored() for level in levels]
        last = len(symbol) - 1
        end = at + period + extension(levels, at, at + period)
        start = at + 1 - extension(mirror, last - at, last - at - period)
        long = end - start >= np.maximum(min_length, TIMES * period)
        runs = _least(np.concatenate([runs, np.stack([start[long], end[long], period[long]])], 1))
    start, end, period = runs
    order = np.lexsort((period, start))
    before = np.searchsorted(place, start[order], "right")
    return start[order] - before, end[order] - before, period[order]


def _least(runs: np.ndarray) -> np.ndarray:
    """For each pair of ends, the least period."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    return runs[:, np.append(True, (runs[:2, 1:] != runs[:2, :-1]).any(0))] if runs.shape[1] else runs


def _kept(texts: Texts, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> pa.Array:
    """Each row's words, joined by one blank."""
    length = end - start
    blank = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
    place = np.concatenate(([0], np.cumsum(length + blank)))
    data = np.full(place[-1], 0x20, np.uint8)
    data[ranges(place[:-1], length)] = texts.data[ranges(start, length)]
    offsets = place[np.searchsorted(row, np.arange(len(texts) + 1))].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _found(ids: pa.Array, texts: Texts, min_length: int) -> pa.RecordBatch:
    words = words_of(texts)
    start, end, period = runs_of(words.print, words.bounds, min_length)
    change = np.zeros(len(words.print) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    stays = np.cumsum(change[:-1]) == 0
    doc = np.searchsorted(words.bounds, start, "right") - 1
    fields = [start - words.bounds[doc], end - start, period]
    listed = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["start", "length", "period"])
    cuts = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(words.bounds)), pa.ListArray.from_arrays(cuts, listed), _kept(texts, words.start[stays], words.end[stays], words.row[stays])],
        ["doc_id", "n_words", "runs", "kept"],
    )


def periodic_runs(docs: DataFrame, min_length: int = 24) -> DataFrame:
    """(doc_id, n_words, runs, kept) of each row: its runs by start and period, and its words without the repeats, joined by one blank.

    Words are runs of bytes other than blank and 0x09 to 0x0D, numbered from 0; a null text has none. A run is a stretch of at least min_length words and three
    times its smallest period, which no neighbour continues. A word goes if a run holds it after that run's first period.
    Every row is judged alone, so ids may be null or repeat; other columns are not looked at.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch["text"], CHUNK_BYTES):
                yield _found(batch["doc_id"].slice(texts.first, len(texts)), texts, min_length)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, FOUND)


def strongest(runs: Column) -> Column:
    """The run with the greatest length for its period, exactly; of equal ones the first. Null without runs."""
    more = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.reduce(runs, none, lambda best, run: F.when(more(best, run), run).otherwise(best))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by crc32 of the id, repeat a stretch of their words up to the end. Others, and null ids, stay as they are."""

    def repeat(doc_id: int | None, text: str | None) -> str | None:
        seed = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        words = re.findall("[^\x20\x09-\x0d]+", text or "") if seed % 10 == 0 else []
        if not words:
            return text
        seed //= 10
        a = seed % len(words)
        p = 1 + (len(words) - a) // (3 + seed % 8)
        return " ".join(words[:a] + [words[a + k % p] for k in range(len(words) - a)])

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [repeat(*row) for row in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(change, "doc_id long, text string")
