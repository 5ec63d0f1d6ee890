"""Words, shingles and fingerprints of whole columns of text at once, on the UTF-8 bytes that Arrow already holds.

A word is a run of bytes other than blank and 0x09 to 0x0D. All fingerprints are 64-bit and depend on content only, so they agree
between tasks, machines and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(count: int, seed: int) -> np.ndarray:
    """So many odd 64-bit numbers that depend on the seed alone."""
    steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(seed)) | np.uint64(1)


_BYTE = seeded(256, 11)
_PLACE = seeded(64, 12)
_STEP = seeded(16, 13)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z folded, other bytes as they are."""
    return _LOWER[data]


@dataclass
class Texts:
    """Some rows' texts as bytes: row i is data[bounds[i]:bounds[i + 1]]."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.bounds) - 1


def texts_of(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The column in pieces of about so many bytes, a row never split; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    _, offsets, values = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + chunk_bytes, "right")) - 1)
        yield Texts(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], start)
        start = end


@dataclass
class Words:
    """Words of some texts: bytes [start, end), row, fingerprint, and each row's range of words."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    print: np.ndarray
    bounds: np.ndarray


def words_of(texts: Texts, lower: bool = False, gap: np.ndarray = _BLANK) -> Words:
    """The texts' words; gap tells for each byte value whether it separates words, lower folds A-Z first."""
    data = _LOWER[texts.data] if lower else texts.data
    inside = ~gap[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    breaks = texts.bounds[1:-1]
    breaks = breaks[breaks < len(data)]
    opens[breaks] = inside[breaks]
    start = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    breaks = breaks[breaks > 0]
    closes[breaks - 1] = inside[breaks - 1]
    end = np.flatnonzero(closes) + 1
    bounds = np.searchsorted(start, texts.bounds)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return Words(start, end, row, spans_print(data, start, end, inside), bounds)


def spans_print(data: np.ndarray, start: np.ndarray, end: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """A fingerprint of each non-empty byte span; spans don't overlap. inside marks exactly their bytes, if known."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    flat = data[inside] if inside is not None else data[ranges(start, length)]
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(flat)) - np.repeat(first, length)
    factor = _PLACE[place & 63]
    far = place >= 64
    if far.any():
        factor[far] = mix(factor[far] + place[far].astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat(_BYTE[flat] * factor, first) + length.astype(np.uint64))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each length, one after the other."""
    length = np.asarray(length)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(np.asarray(start) - before, length)


def chain(prints: list[np.ndarray]) -> np.ndarray:
    """One fingerprint of several in order."""
    total = np.zeros(len(prints[0]), np.uint64)
    for k, one in enumerate(prints):
        total += mix(one + _STEP[k]) * _STEP[-1 - k]
    return mix(total)


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of each window of so many words; a row with fewer words has all its words as its only one."""
    count = np.diff(words.bounds)
    n = len(words.print)
    if n >= size:
        window = chain([words.print[k : n - size + 1 + k] for k in range(size)])
        whole = words.row[: n - size + 1] == words.row[size - 1 :]
        row, prints = words.row[: n - size + 1][whole], window[whole]
    else:
        row, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            at = words.bounds[:-1][short[has]] + k
            extra[has] = mix(extra[has] * np.uint64(3) + words.print[at] + np.uint64(k + 1))
        row, prints = np.concatenate([row, short]), np.concatenate([prints, mix(extra)])
        order = np.argsort(row, kind="stable")
        row, prints = row[order], prints[order]
    return row, prints


def distinct(row: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, fingerprint, times) without repeats inside a row, ordered by row and fingerprint."""
    if not len(row):
        return row, prints, np.zeros(0, np.int64)
    order = np.lexsort((prints, row))
    row, prints = row[order], prints[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (prints[1:] != prints[:-1])
    at = np.flatnonzero(new)
    return row[at], prints[at], np.diff(np.append(at, len(row)))
