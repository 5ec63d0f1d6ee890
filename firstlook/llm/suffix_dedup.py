"""Removal of byte strings that an earlier document holds as well: sampled suffixes are named, names of names settle the rest.

Every string of ``length`` bytes is represented by a sampled suffix inside it: the one whose first k bytes hash lowest. That sample is a
difference cover by content: two equal strings, wherever they begin, always have a sampled suffix at the same shift. Suffixes are not sorted or ranked; step by
step, and each time by asking buckets of fingerprints which documents of the whole corpus hold them:

1. Sampled suffixes are named by their first k bytes. A name in one document alone ends the matter for all strings that it represents.
2. The longest stretch of strings with the same sampled suffix is named by its whole text. If all documents that hold the sampled suffix
   have the same stretch, the first of them decides for all its strings.
3. What remains, at the edges of copied passages, is asked string by string, once for each distinct stretch.

The first step names a thirteenth of all suffixes, the others only what repeats. Fingerprints take the place of ranks as names, so no
step has to number the corpus.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from firstlook.plans.written import written

from . import blocks as B
from .words import ranges, seeded, spans_print, texts_of

KEPT = "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"
CHUNK = 1 << 18
_NO_ID = (1 << 63) - 1
_MIX = seeded(16, 21)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, without a copy."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), 0, (1,))


def _hashed(data: np.ndarray, at: np.ndarray | slice, size: int, salt: int) -> np.ndarray:
    """A fingerprint of the ``size`` bytes (8 at least) from each position on."""
    eights, total = _eights(data), None
    for k, shift in enumerate([*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]):
        part = eights[shift:][at] if isinstance(at, slice) else eights[at + shift]
        part = part * _MIX[(k + salt) % 16]
        part ^= part >> np.uint64(29)
        total = part if total is None else (total + part) * _MIX[(k + salt + 7) % 16]
    total = total ^ (total >> np.uint64(32))
    total *= _MIX[(salt + 3) % 16]
    return total ^ (total >> np.uint64(29))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Stretches:
    """Stretches of strings with one sampled suffix: document, first string's start, number of strings, name of the suffix."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    name: np.ndarray


def _stretches(data: np.ndarray, bounds: np.ndarray, length: int) -> Stretches:
    k = length // 2 + 1
    found, first = [], 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK, "right")) - 1)
        base = bounds[first]
        part, edges = data[base : bounds[last]], bounds[first : last + 1] - base
        if len(part) >= length:
            names = _lowest(_hashed(part, slice(0, len(part) - k + 1), k, 0), length - k + 1)
            doc = np.repeat(np.arange(first, last), np.diff(edges))[: len(names)]
            whole = np.arange(len(names)) + length <= edges[doc - first + 1]
            new = np.ones(len(names), bool)
            new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
            new &= whole
            at = np.flatnonzero(new)
            stop = np.append(at[1:], len(names))
            count = np.minimum(stop, edges[doc[at] - first + 1] - length + 1) - at
            found.append((doc[at], at + base, count, names[at]))
        first = last
    if not found:
        empty = np.zeros(0, np.int64)
        return Stretches(empty, empty, empty, np.zeros(0, np.uint64))
    return Stretches(*(np.concatenate(x) for x in zip(*found)))


def text_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, block, key): 16 bytes that tell a row's text from others."""
    return docs.select("doc_id", "block", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("key"))


class _Block:
    """A block's texts that no smaller id has, their stretches, and what the corpus has answered so far."""

    def __init__(self, texts: pa.Table, told: pa.Table, length: int, buckets: int) -> None:
        self.length, self.buckets = length, buckets
        kinds = told["kind"].to_numpy()
        answers = told["answer"].to_pylist()
        self.of_bucket = {(int(k), int(b)): a for k, b, a in zip(kinds, told["bucket"].to_pylist(), answers) if k >= 0}
        firsts = {a[:16]: int.from_bytes(a[16:], "big", signed=True) for k, a in zip(kinds, answers) if k < 0}
        self.ids = [_NO_ID if i is None else i for i in texts["doc_id"].to_pylist()]
        self.first_id, self.place = [], []
        seen: dict[bytes, int] = {}
        parts, sizes = [], []
        for _, column in B.texts_in(texts):
            for some in texts_of(column, CHUNK):
                for a, b in zip(some.bounds, some.bounds[1:]):
                    text = some.data[a:b]
                    key = hashlib.sha256(text).digest()[:16]
                    row = len(self.first_id)
                    self.first_id.append(firsts[key])
                    if self.ids[row] != firsts[key]:
                        self.place.append(-1)
                        continue
                    if key not in seen:
                        seen[key] = len(parts)
                        parts.append(text)
                    self.place.append(seen[key])
                sizes += np.diff(some.bounds).tolist()
        self.sizes = sizes
        self.data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        self.bounds = np.cumsum([0] + [len(p) for p in parts])
        self.doc_ids = np.zeros(len(parts), np.int64)
        for row, place in enumerate(self.place):
            if place >= 0:
                self.doc_ids[place] = self.ids[row]
        self.all = _stretches(self.data, self.bounds, length)
        self.names, self.times = self._names()

    def _names(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct names of sampled suffixes, and whether each is in one document (0) or several (1)."""
        order = np.lexsort((self.all.doc, self.all.name))
        name, doc = self.all.name[order], self.all.doc[order]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(name)) - 1
        return name[at], (doc[at] != doc[last]).astype(np.int64) if len(at) else np.zeros(0, np.int64)

    def answered(self, kind: int, names: np.ndarray, read) -> list[np.ndarray]:
        """The answers about names, in their order: read gives columns of numbers from an answer's bytes."""
        edges = B.bucket_edges(names, self.buckets)
        parts = [read(self.of_bucket[kind, b]) for b in np.flatnonzero(np.diff(edges)).tolist()]
        return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 2

    def repeated(self) -> Stretches:
        """The stretches whose sampled suffix is in several documents."""
        shared = self.answered(0, self.names, lambda a: [B.unpacked(a)])[0].astype(bool)
        if not shared.any():
            return Stretches(*(x[:0] for x in (self.all.doc, self.all.start, self.all.count, self.all.name)))
        names = self.names[shared]
        at = np.minimum(np.searchsorted(names, self.all.name), len(names) - 1)
        keep = names[at] == self.all.name
        return Stretches(self.all.doc[keep], self.all.start[keep], self.all.count[keep], self.all.name[keep])

    def variants(self, some: Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct (suffix name, stretch name) with the first id that has it here, and each stretch's place among them."""
        text = spans_print(self.data, some.start, some.start + some.count + self.length - 1)
        own = self.doc_ids[some.doc]
        return _least(some.name, text, own)

    def windows(self, some: Stretches, of: np.ndarray, asks: np.ndarray):
        """The strings of stretches whose variant asks, once for each: (stretch, start, two names)."""
        picked = np.flatnonzero(asks[of])
        stretch = np.repeat(picked, some.count[picked])
        start = ranges(some.start[picked], some.count[picked])
        return stretch, start, _hashed(self.data, start, self.length, 1), _hashed(self.data, start, self.length, 5)


def _least(one: np.ndarray, two: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, the least value of each, and each row's place among them."""
    order = np.lexsort((value, two, one))
    a, b = one[order], two[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    return a[at], b[at], value[order][at], of


def _pairs(block: int, kind: int, one: np.ndarray, two: np.ndarray, value: np.ndarray, buckets: int) -> list[tuple]:
    """Questions about ascending pairs of names with a value each."""
    edges = B.bucket_edges(one, buckets)
    cut = lambda b: slice(edges[b], edges[b + 1])
    return [
        (b, block, kind, B.packed_names(one[cut(b)]), two[cut(b)].astype("<u8").tobytes() + B.packed(value[cut(b)]))
        for b in np.flatnonzero(np.diff(edges)).tolist()
    ]


def _asked_pairs(table: pa.Table):
    """All blocks' pairs in a bucket: names, second names, values and where each question's rows end."""
    ones = [B.unpacked_names(x.as_py()) for x in table["names"]]
    extras = [x.as_py() for x in table["extra"]]
    twos = [np.frombuffer(e, "<u8", len(n)) for e, n in zip(extras, ones)]
    values = [B.unpacked(e[8 * len(n) :]).astype(np.int64) for e, n in zip(extras, ones)]
    return np.concatenate(ones), np.concatenate(twos), np.concatenate(values), np.cumsum([0] + [len(n) for n in ones])


def _answers(table: pa.Table, kind: int, edges: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    bucket = table["bucket"][0].as_py()

    def told(a: int, b: int) -> bytes:
        parts = [B.packed(c[a:b]) for c in columns]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    return [(block, bucket, kind, told(a, b)) for block, a, b in zip(table["block"].to_pylist(), edges, edges[1:])]


def _columns(answer: bytes) -> list[np.ndarray]:
    found, at = [], 0
    while at < len(answer):
        size = int.from_bytes(answer[at : at + 8], "little")
        found.append(B.unpacked(answer[at + 8 : at + 8 + size]).astype(np.int64))
        at += 8 + size
    return found


def _shared_names(table: pa.Table) -> list[tuple]:
    """Whether each sampled suffix's name is in several documents."""
    lists = [B.unpacked_names(x.as_py()) for x in table["names"]]
    several = np.concatenate([B.unpacked(x.as_py()) for x in table["extra"]])
    names, of, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    several = (np.bincount(of, weights=several, minlength=len(names)) > 0) | (times > 1)
    edges, bucket = np.cumsum([0] + [len(x) for x in lists]), table["bucket"][0].as_py()
    return [(b, bucket, 0, B.packed(several[of[s:e]].astype(np.int64))) for b, s, e in zip(table["block"].to_pylist(), edges, edges[1:])]


def _first_variants(table: pa.Table) -> list[tuple]:
    """The first id of each variant, and whether its sampled suffix has others."""
    one, two, value, edges = _asked_pairs(table)
    a, _, first, of = _least(one, two, value)
    names, variants = np.unique(a, return_counts=True)
    several = variants[np.searchsorted(names, a)] > 1
    return _answers(table, 1, edges, first[of], several[of].astype(np.int64))


def _first_windows(table: pa.Table) -> list[tuple]:
    """The first id of each string."""
    one, two, value, edges = _asked_pairs(table)
    _, _, first, of = _least(one, two, value)
    return _answers(table, 2, edges, first[of])


def without_repeats(docs: DataFrame, length: int = 50, block_bytes: int = B.BLOCK_BYTES, rest: bool = False) -> DataFrame:
    """Each row of docs (doc_id, text) without the bytes of strings of ``length`` bytes that start in a row with a smaller id as well.

    Texts are UTF-8 bytes, null as empty; strings don't cross rows; overlaps count; strings are judged on the input. starts and ends are the
    maximal removed runs, kept the remaining bytes. Rows with equal ids don't remove anything from each other, and a null id is larger than
    all others. Texts shorter than ``length`` (16 at least) are kept whole. Other columns are ignored, or come along as the struct ``rest``.
    """
    rows, count = B.in_blocks(docs, block_bytes, rest)
    buckets = B.buckets_for(count, 0.08, block_bytes)
    keyed = written(text_keys(rows).distinct())
    firsts = keyed.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("first"))
    known = keyed.select("block", "key").distinct().join(firsts, "key")
    eight_bytes = F.unhex(F.lpad(F.hex("first"), 16, "0"))
    known = written(known.select("block", F.lit(0).cast("long").alias("bucket"), F.lit(-1).alias("kind"), F.concat("key", eight_bytes).alias("answer")))

    def block_of(texts: pa.Table, told: pa.Table) -> tuple[int, _Block]:
        return texts["block"][0].as_py(), _Block(texts, told, length, buckets)

    def ask_names(texts: pa.Table, told: pa.Table) -> pa.Table:
        block, own = block_of(texts, told)
        return B.table_of(B.questions(block, 0, own.names, own.times, buckets), B.ASKED)

    def ask_variants(texts: pa.Table, told: pa.Table) -> pa.Table:
        block, own = block_of(texts, told)
        one, two, first, _ = own.variants(own.repeated())
        return B.table_of(_pairs(block, 1, one, two, first, buckets), B.ASKED)

    def opened(own: _Block):
        """Repeated stretches, their variants' places, the first ids of variants, and which must be sorted string by string here."""
        some = own.repeated()
        one, _, first, of = own.variants(some)
        everywhere, several = own.answered(1, one, _columns)
        return some, of, everywhere, (several > 0) & (everywhere == first)

    def ask_windows(texts: pa.Table, told: pa.Table) -> pa.Table:
        block, own = block_of(texts, told)
        some, of, everywhere, asks = opened(own)
        asks_here = asks[of] & (own.doc_ids[some.doc] == everywhere[of])
        stretch, _, high, low = own.windows(some, np.arange(len(of)), asks_here)
        one, two, first, _ = _least(high, low, own.doc_ids[some.doc[stretch]])
        return B.table_of(_pairs(block, 2, one, two, first, buckets), B.ASKED)

    def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
        _, own = block_of(texts, told)
        some, of, everywhere, asks = opened(own)
        ids = own.doc_ids[some.doc]
        step = np.zeros(len(own.data) + 1, np.int64)
        early = everywhere[of] < ids
        np.add.at(step, some.start[early], 1)
        np.add.at(step, some.start[early] + some.count[early] + length - 1, -1)
        stretch, start, high, low = own.windows(some, np.arange(len(of)), asks[of] & (ids == everywhere[of]))
        one, _, _, place = _least(high, low, ids[stretch])
        before = own.answered(2, one, _columns)[0][place] < ids[stretch] if len(one) else np.zeros(0, bool)
        np.add.at(step, start[before], 1)
        np.add.at(step, start[before] + length, -1)
        gone = np.cumsum(step[:-1]) > 0
        out = []
        for row, place in enumerate(own.place):
            size = own.sizes[row]
            if place < 0:
                whole = size >= length
                text = b"" if whole else texts["text"][row].as_py().encode()
                out.append((size, size if whole else 0, [0] if whole else [], [size] if whole else [], text))
                continue
            part, mask = own.data[own.bounds[place] : own.bounds[place + 1]], gone[own.bounds[place] : own.bounds[place + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
            out.append((size, int(mask.sum()), edge[::2].tolist(), edge[1::2].tolist(), part[~mask].tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        table = pa.table([texts["doc_id"], *columns], names=["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept"])
        return table.append_column("rest", texts["rest"]) if rest else table

    names = B.answer(B.told(rows, known, ask_names, B.ASKED), _shared_names)
    told = written(known.unionByName(names))
    variants = B.answer(B.told(rows, told, ask_variants, B.ASKED), _first_variants)
    told = written(told.unionByName(variants))
    windows = B.answer(B.told(rows, told, ask_windows, B.ASKED), _first_windows)
    schema = StructType.fromDDL(KEPT)
    return B.told(rows, told.unionByName(windows), finish, schema.add(rows.schema["rest"]) if rest else schema)
