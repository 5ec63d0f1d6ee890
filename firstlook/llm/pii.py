"""Personal data in texts: fixed patterns, and a character tagger that finds more of their kind.

The tagger is a bidirectional LSTM over classes of characters with CRF transitions between tags, in numpy. It is trained on spans that the
patterns label in a bounded sample of windows. A text is cut into windows that overlap by half; each is decoded on its own, and the spans of
all windows of a text are reconciled: the surest come first, and none may overlap another one or a pattern's. Every kind holds a digit or an
at sign, so windows without either need no decoding.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import learning

KINDS = ("email", "ip", "card", "phone")
SPANS = "doc_id long, spans array<struct<kind:int,start:int,end:int,by_rule:boolean>>"
WINDOW = 64
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(values)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            after = domain.end()
        at = text.find("@", max(after, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        start = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the patterns find, leftmost and without overlap within a kind; by kind and start, in code points."""
    if not _TRIGGER.search(text):
        return []
    found = [(0, *s) for s in _emails(text)]
    found += [(1, *s) for s in _ips(text)]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            found.append((3, *m.span()))
    return found


def _classes(text: str) -> np.ndarray:
    """Each character's class: letters by case, digits, blanks and line breaks as one class each, other ASCII by themselves."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return _CLASS_OF[np.minimum(code, 128)]


def _class_table() -> np.ndarray:
    table = np.zeros(129, np.int64)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    for k, c in enumerate(marks):
        table[c] = 6 + k
    for c in range(128):
        table[c] = 1 if chr(c).islower() else 2 if chr(c).isupper() else 3 if chr(c).isdigit() else 4 if chr(c).isspace() else table[c]
    table[128] = 5
    return table


_CLASS_OF = _class_table()
N_CLASSES = int(_CLASS_OF.max()) + 1
N_TAGS = 1 + 2 * len(KINDS)


def _window_starts(text: str, size: int) -> list[int]:
    """Starts of the half-overlapping windows that hold a digit or an at sign."""
    half, held = size // 2, set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // half
        held.update((k, max(k - 1, 0)))
    return [k * half for k in sorted(held)]


def _tags(spans: list[tuple[int, int, int]], start: int, size: int) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for kind, a, b in spans:
        if a >= start and b <= start + size and not tags[a - start : b - start].any():
            tags[a - start : b - start] = 2 + 2 * kind
            tags[a - start] = 1 + 2 * kind
    return tags


def _forbidden() -> np.ndarray:
    """What no sequence may hold: an inner tag that follows neither its own first tag nor itself."""
    bad = np.zeros((N_TAGS, N_TAGS), bool)
    for kind in range(len(KINDS)):
        inner = 2 + 2 * kind
        bad[:, inner] = True
        bad[[inner - 1, inner], inner] = False
    return bad


_FORBIDDEN = _forbidden()


@dataclass
class Tagger:
    """Parameters: embedding; input, recurrent weights and bias for each direction; output weights and bias; transitions; first tags."""

    params: list[np.ndarray]
    size: int = WINDOW

    @classmethod
    def fresh(cls, embed: int, hidden: int, size: int) -> "Tagger":
        random = np.random.default_rng(3)
        shapes = [(N_CLASSES, embed)] + [s for _ in range(2) for s in ((embed, 4 * hidden), (hidden, 4 * hidden), (4 * hidden,))]
        shapes += [(2 * hidden, N_TAGS), (N_TAGS,), (N_TAGS, N_TAGS), (N_TAGS,)]
        params = [random.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s) for s in shapes]
        for bias in (params[3], params[6]):
            bias[hidden : 2 * hidden] = 1.0
        return cls(params, size)

    def _run(self, x: np.ndarray, weights: list[np.ndarray]):
        """One direction over (time, batch, embed): hidden states, and what the way back needs."""
        w_x, w_h, bias = weights
        hidden = w_h.shape[0]
        h = c = np.zeros((x.shape[1], hidden))
        inputs, states, kept = x @ w_x + bias, [], []
        for z in inputs:
            z = z + h @ w_h
            gates = learning.sigmoid(z[:, : 3 * hidden])
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            g = np.tanh(z[:, 3 * hidden :])
            before = c
            c = f * c + i * g
            t = np.tanh(c)
            kept.append((i, f, o, g, before, t, h))
            h = o * t
            states.append(h)
        return np.stack(states), kept

    def _back(self, x: np.ndarray, weights: list[np.ndarray], kept, d_states: np.ndarray):
        w_x, w_h, _ = weights
        d_h = d_c = np.zeros_like(d_states[0])
        d_z = np.empty((*d_states.shape[:2], w_h.shape[1]))
        g_h = np.zeros_like(w_h)
        for t in range(len(kept) - 1, -1, -1):
            i, f, o, g, before, tc, h = kept[t]
            d_h = d_h + d_states[t]
            d_c = d_c + d_h * o * (1 - tc * tc)
            d_z[t] = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
            g_h += h.T @ d_z[t]
            d_h = d_z[t] @ w_h.T
            d_c = d_c * f
        flat = d_z.reshape(-1, d_z.shape[2])
        return [x.reshape(-1, x.shape[2]).T @ flat, g_h, flat.sum(0)], d_z @ w_x.T

    def _scores(self, codes: np.ndarray):
        """Tag scores (time, batch, tag) of windows (batch, time)."""
        p, x = self.params, self.params[0][codes.T]
        ahead, kept_a = self._run(x, p[1:4])
        behind, kept_b = self._run(x[::-1], p[4:7])
        states = np.concatenate([ahead, behind[::-1]], axis=2)
        return states @ p[7] + p[8], (x, states, kept_a, kept_b)

    def _transitions(self) -> tuple[np.ndarray, np.ndarray]:
        first = self.params[10].copy()
        first[2::2] = -1e4
        return np.where(_FORBIDDEN, -1e4, self.params[9]), first

    def _sums(self, scores: np.ndarray):
        """Forward and backward sums in logarithms, and the total of each window."""
        between, first = self._transitions()
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + first
        for t in range(1, len(scores)):
            alpha[t] = _log_sum(alpha[t - 1][:, :, None] + between, 1) + scores[t]
        for t in range(len(scores) - 2, -1, -1):
            beta[t] = _log_sum(between + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, _log_sum(alpha[-1], 1)

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-likelihood of the tags."""
        n, p = len(codes), self.params
        scores, (x, states, kept_a, kept_b) = self._scores(codes)
        alpha, beta, total = self._sums(scores)
        between, _ = self._transitions()
        share = np.exp(alpha + beta - total[:, None])
        d_scores = share.copy()
        at, who = np.meshgrid(np.arange(tags.shape[1]), np.arange(n), indexing="ij")
        d_scores[at, who, tags.T] -= 1
        d_scores /= n
        d_between = np.zeros_like(between)
        for t in range(len(scores) - 1):
            both = alpha[t][:, :, None] + between + (scores[t + 1] + beta[t + 1])[:, None, :] - total[:, None, None]
            d_between += np.exp(both).sum(0)
        np.add.at(d_between, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        d_between = np.where(_FORBIDDEN, 0, d_between / n)
        d_first = d_scores[0].sum(0)
        d_first[2::2] = 0
        d_states = d_scores @ p[7].T
        hidden = states.shape[2] // 2
        grads_a, d_x = self._back(x, p[1:4], kept_a, d_states[:, :, :hidden])
        grads_b, d_xb = self._back(x[::-1], p[4:7], kept_b, d_states[::-1, :, hidden:])
        d_embed = np.zeros_like(p[0])
        np.add.at(d_embed, codes.T, d_x + d_xb[::-1])
        flat = d_scores.reshape(-1, N_TAGS)
        return [d_embed, *grads_a, *grads_b, states.reshape(-1, 2 * hidden).T @ flat, flat.sum(0), d_between, d_first]

    def decode(self, codes: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """(kind, start, end, sureness) of the best tags of each window; sureness is the least probability of a tag in the span."""
        scores, _ = self._scores(codes)
        alpha, beta, total = self._sums(scores)
        share = np.exp(alpha + beta - total[:, None])
        between, first = self._transitions()
        best, back = scores[0] + first, []
        for t in range(1, len(scores)):
            ways = best[:, :, None] + between
            back.append(ways.argmax(1))
            best = ways.max(1) + scores[t]
        tags = np.empty(codes.shape, np.int64)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(len(codes))
        for t in range(codes.shape[1] - 2, -1, -1):
            tags[:, t] = back[t][rows, tags[:, t + 1]]
        found = []
        for row in range(len(codes)):
            spans, line = [], tags[row]
            for start in np.flatnonzero(line % 2 == 1):
                end = start + 1
                while end < len(line) and line[end] == line[start] + 1:
                    end += 1
                sure = share[np.arange(start, end), row, line[start:end]].min()
                spans.append(((int(line[start]) - 1) // 2, int(start), int(end), float(sure)))
            found.append(spans)
        return found


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit_tagger(
    docs: DataFrame, most_docs: int = 2_000, most_windows: int = 4_000, embed: int = 12, hidden: int = 24, steps: int = 300, batch: int = 32,
) -> Tagger | None:
    """A tagger trained on the patterns' spans in a sample of docs (doc_id, text); None if the sample has no span.

    The sample is at most most_docs documents that hold a digit or an at sign, those whose ids hash lowest, and most_windows of their windows.
    """
    ids = learning.few(docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).select("doc_id"), most_docs, "pii")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for text in part["text"].to_pylist():
                spans, codes = rule_spans(text), _classes(text)
                for start in _window_starts(text, WINDOW):
                    window = np.full(WINDOW, 4, np.int64)
                    window[: len(codes[start : start + WINDOW])] = codes[start : start + WINDOW]
                    rows.append((window.astype(np.uint8).tobytes(), _tags(spans, start, WINDOW).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_pydict({"codes": pa.array([r[0] for r in rows], pa.binary()), "tags": pa.array([r[1] for r in rows], pa.binary())})

    made = learning.with_texts(docs, ids).select("text").mapInArrow(windows, "codes binary, tags binary")
    rows = made.orderBy(F.xxhash64("codes"), "tags").limit(most_windows).collect()
    codes = np.array([np.frombuffer(r.codes, np.uint8) for r in rows], np.int64).reshape(-1, WINDOW)
    tags = np.array([np.frombuffer(r.tags, np.uint8) for r in rows], np.int64).reshape(-1, WINDOW)
    if not tags.any():
        return None
    random, tagger = np.random.default_rng(4), Tagger.fresh(embed, hidden, WINDOW)

    def gradients(now: list[np.ndarray], step: int) -> list[np.ndarray]:
        some = random.integers(0, len(codes), batch)
        return Tagger(now).gradients(codes[some], tags[some])

    return Tagger(learning.adam(tagger.params, gradients, steps, 0.03))


def _plausible(kind: int, text: str) -> bool:
    digits = len(_digits(text))
    return (text.count("@") == 1, 4 <= digits <= 12 and text.count(".") == 3, 13 <= digits <= 19, 8 <= digits <= 15)[kind]


def reconciled(rules: list[tuple[int, int, int]], tagged: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, bool]]:
    """The patterns' spans, and of the tagged ones the surest that overlap nothing taken; by kind and start."""
    taken = sorted((a, b) for _, a, b in rules)
    found = [(*r, True) for r in rules]
    reach = max((b - a for a, b in taken), default=0)
    for kind, a, b, _ in sorted(set(tagged), key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        near = taken[bisect_left(taken, (a - reach, 0)) : bisect_left(taken, (b, 0))]
        if all(end <= a for _, end in near):
            insort(taken, (a, b))
            reach = max(reach, b - a)
            found.append((kind, a, b, False))
    return sorted(found)


def pii_spans(docs: DataFrame, tagger: Tagger | None, sure: float = 0.9) -> DataFrame:
    """(doc_id, spans): each row's spans (kind, start, end, by_rule) in code points, by kind and start; kind is an index of KINDS.

    Takes doc_id and text; a row for each row, whatever its id; null and empty texts have no spans. The tagger's spans count from a
    probability of ``sure`` for each tag on, if they have the digits of their kind, and if they don't touch an inner edge of their window.
    """
    names = ("kind", "start", "end", "by_rule")
    kind = pa.list_(pa.struct(list(zip(names, (pa.int32(), pa.int32(), pa.int32(), pa.bool_())))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = all_spans([t or "" for t in part["text"].to_pylist()], tagger, sure)
                lists = [[dict(zip(names, s)) for s in spans] for spans in found]
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "spans": pa.array(lists, kind)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, SPANS)


def all_spans(texts: list[str], tagger: Tagger | None, sure: float) -> list[list[tuple[int, int, int, bool]]]:
    """The reconciled spans of each text; windows of all texts are decoded together, some hundred at a time."""
    rules = [rule_spans(t) for t in texts]
    tagged: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if tagger is not None:
        waiting: list[tuple[int, int]] = [(row, s) for row, t in enumerate(texts) for s in _window_starts(t, tagger.size)]
        for k in range(0, len(waiting), 256):
            some = waiting[k : k + 256]
            codes = np.full((len(some), tagger.size), 4, np.int64)
            for line, (row, start) in zip(codes, some):
                own = _classes(texts[row][start : start + tagger.size])
                line[: len(own)] = own
            for (row, start), spans in zip(some, tagger.decode(codes)):
                text = texts[row]
                for kind, a, b, p in spans:
                    a, b = a + start, b + start
                    inner = (a > start or start == 0) and (b < start + tagger.size or b == len(text))
                    if p >= sure and inner and b <= len(text) and _plausible(kind, text[a:b]):
                        tagged[row].append((kind, a, b, p))
    return [reconciled(r, t) for r, t in zip(rules, tagged)]


def redacted(text: str, spans: list[tuple[int, int]], names: list[str]) -> str:
    """The text with each run of overlapping spans replaced by the first one's name."""
    parts, at = [], 0
    for (start, end), name in sorted(zip(spans, names)):
        if start >= at:
            parts += [text[at:start], f"[{name}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, tagger: Tagger | None, sure: float = 0.9) -> DataFrame:
    """docs with each span in the column text replaced by [EMAIL], [IP], [CARD] or [PHONE]; null texts become empty, other columns stay."""
    place = docs.columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part["text"].to_pylist()]
                new = [
                    redacted(text, [s[1:3] for s in spans], [KINDS[s[0]].upper() for s in spans]) if spans else text
                    for text, spans in zip(texts, all_spans(texts, tagger, sure))
                ]
                yield part.set_column(place, "text", pa.array(new, pa.string()))

    return docs.mapInArrow(replace, docs.schema)
