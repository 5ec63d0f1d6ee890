"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass search.

At each position the automaton's state names the longest piece that ends there, and its output links name all shorter ones. A byte that
no piece covers becomes its byte piece. Pieces never reach over the start of a word (the vocabulary is checked for that), so words are
searched on their own, each distinct one of a chunk once, and side by side.

Which piece is right depends on the kind of model. A unigram model's ids are those of the best sum of scores (Viterbi). The scores of a BPE
model are the order of its merges, and the best sum of them is not what its merges make. There, the last piece of each prefix is the
one that merging would leave beside the last piece of the prefix before it; exactly one is. The ids are SentencePiece's own, but for the
character U+2581: SentencePiece reads it as a blank, and here it becomes byte pieces, so that decoding gives the text again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import ranges, spans_print, texts_of

CHUNK_BYTES = 4 << 20
_SPACE = "▁"
_vocabularies: dict[str, "Pieces"] = {}


class Pieces:
    """A vocabulary's pieces as an automaton on bytes, in which a blank stands for the mark of a word's start."""

    def __init__(self, pieces: list[tuple[int, bytes, float]], byte_ids: np.ndarray, size: int) -> None:
        lowest = min((s for _, _, s in pieces), default=0.0)
        self.byte_ids, self.byte_score = byte_ids, lowest - 10.0
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for number, text, _ in pieces:
            node = 0
            for byte in text:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    piece.append(-1)
                node = children[node][byte]
            piece[node] = number
        self.goto = np.zeros((len(children), 256), np.int32)
        link = np.zeros(len(children), np.int32)
        fail = np.zeros(len(children), np.int32)
        level = [0]
        while level:
            below = []
            for node in level:
                row = self.goto[node]
                if node:
                    row[:] = self.goto[fail[node]]
                for byte, child in children[node].items():
                    fail[child] = row[byte] if node else 0
                    link[child] = fail[child] if piece[fail[child]] >= 0 else link[fail[child]]
                    row[byte] = child
                    below.append(child)
            level = below
        self.piece, self.link = np.array(piece, np.int32), link
        self.first_output = np.where(self.piece >= 0, np.arange(len(piece), dtype=np.int32), link)
        contents = {n: t for n, t, _ in pieces} | {int(n): bytes([b]) for b, n in enumerate(byte_ids)}
        self.length = np.array([len(contents.get(n, b"")) for n in range(size)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(contents.get(n, b"") for n in range(size)), np.uint8)
        self.score = np.full(size, self.byte_score)
        for n, _, s in pieces:
            self.score[n] = s
        used = np.zeros(256, bool)
        used[np.unique(np.frombuffer(b"".join(t for _, t, _ in pieces) or b"\0", np.uint8))] = True
        self.unused = ~used
        self.by_words = all(b" " not in t.lstrip(b" ") for _, t, _ in pieces)
        self.merges = False

    @classmethod
    def load(cls, path: str) -> "Pieces":
        """The vocabulary of a SentencePiece model file with byte pieces, read once a process."""
        if path not in _vocabularies:
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            kind = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec.model_type
            byte_ids, pieces = np.zeros(256, np.int64), []
            for n in range(model.get_piece_size()):
                text = model.id_to_piece(n)
                if model.is_byte(n):
                    byte_ids[int(text[1:-1], 16)] = n
                elif not (model.is_unknown(n) or model.is_control(n) or model.is_unused(n)):
                    pieces.append((n, text.replace(_SPACE, " ").encode(), model.get_score(n)))
            made = cls(pieces, byte_ids, model.get_piece_size())
            if kind == sentencepiece_model_pb2.TrainerSpec.BPE:
                made._learn_merges(pieces)
            _vocabularies[path] = made
        return _vocabularies[path]

    def _learn_merges(self, pieces: list[tuple[int, bytes, float]]) -> None:
        """Each piece's rank among the merges and the two pieces of its last merge. Pieces that merging never makes end nowhere.

        Single characters and bytes rank below all merges, and are their own parts.
        """
        texts = {t.decode(): n for n, t, _ in pieces}
        size = len(self.length)
        merged = [n for n, _, _ in sorted((x for x in pieces if len(x[1].decode()) > 1), key=lambda x: -x[2])]
        self.rank = np.full(size, -1, np.int64)
        self.rank[merged] = np.arange(len(merged))
        self.left, self.right = np.arange(size), np.arange(size)
        rank, never, pairs = {t: int(self.rank[n]) for t, n in texts.items()}, [], {}
        for text, n in texts.items():
            parts, last = list(text), None
            while len(parts) > 1:
                least, k = min((rank.get(a + b, size), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if least == size:
                    break
                last = parts[k], parts[k + 1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) > 1 or last and not (last[0] in texts and last[1] in texts):
                never.append(n)
            elif last:
                self.left[n], self.right[n] = texts[last[0]], texts[last[1]]
                pairs[texts[last[0]] * size + texts[last[1]]] = self.rank[n]
        order = sorted(pairs)
        self.pair, self.pair_rank = np.array([*order, 1 << 62]), np.array([*(pairs[k] for k in order), size])
        self.made = np.ones(size, bool)
        self.made[never] = False
        self.merges = True

    def _stay(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging leaves both pieces of each pair as they are, side by side.

        The merges that made them are taken back, the latest first; at each step, no merge over the border may come before
        those taken back. Of equal merges the left one comes first.
        """
        one, two, answer = one.astype(np.int64), two.astype(np.int64), np.ones(len(one), bool)
        live, limit = np.arange(len(one)), np.full(len(one), 1 << 40)
        while len(live):
            key = one * len(self.length) + two
            at = np.searchsorted(self.pair, key)
            over = (self.pair[at] == key) & (self.pair_rank[at] < limit)
            answer[live[over]] = False
            rank_one, rank_two = self.rank[one], self.rank[two]
            on = ~over & ((rank_one >= 0) | (rank_two >= 0))
            first = rank_one > rank_two
            limit = np.where(first, rank_one, rank_two + 1)[on]
            one, two, live = np.where(first, self.right[one], one)[on], np.where(first, two, self.left[two])[on], live[on]
        return answer

    def _units(self, stream: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the parts begin that no piece reaches out of."""
        begins = np.zeros(len(stream), bool)
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        if self.by_words:
            blank = stream == 0x20
            begins[1:] |= blank[1:] & ~blank[:-1]
        alone = self.unused[stream]
        begins |= alone
        begins[1:] |= alone[:-1]
        return np.flatnonzero(begins)

    def encode(self, stream: np.ndarray, bounds: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, one row after the other, and each row's range of them. A row's stream begins with a blank, or is empty.

        The ids are those of the best sum of scores; own: those that the model itself gives.
        """
        start = self._units(stream, bounds)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        end = np.append(start[1:], len(stream))
        _, first, of = np.unique(spans_print(stream, start, end), return_index=True, return_inverse=True)
        ids, edges = self._search(stream, start[first], end[first], own and self.merges)
        count = np.diff(edges)[of]
        spread = ids[ranges(edges[:-1][of], count)]
        before = np.concatenate(([0], np.cumsum(count)))
        return spread, before[np.searchsorted(start, bounds)]

    def _search(self, stream: np.ndarray, start: np.ndarray, end: np.ndarray, merges: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each span, and each span's range of them: by merges, or of the best score, where longer pieces win ties."""
        order = np.argsort(start - end, kind="stable")
        length = (end - start)[order]
        begin = start[order]
        cell = np.cumsum(length + 1) - (length + 1)
        best = np.full(int((length + 1).sum()), -np.inf)
        back = np.zeros(len(best), np.int32)
        best[cell] = 0.0
        state = np.zeros(len(order), np.int32)
        for t in range(int(length[0])):
            n = int(np.searchsorted(-length, -t, "left"))
            byte = stream[begin[:n] + t]
            state[:n] = self.goto[state[:n], byte]
            here = cell[:n] + t
            top, choice = best[here] + self.byte_score, self.byte_ids[byte]
            node, who = self.first_output[state[:n]], np.arange(n)
            while True:
                open_ = node > 0
                if not open_.all():
                    node, who = node[open_], who[open_]
                if not len(node):
                    break
                piece = self.piece[node]
                if merges:
                    before = here[who] + 1 - self.length[piece]
                    fits = self.made[piece] & ((before == cell[who]) | self._stay(back[before], piece))
                    choice[who[fits]] = piece[fits]
                    node, who = self.link[node[~fits]], who[~fits]
                    continue
                value = best[here[who] + 1 - self.length[piece]] + self.score[piece]
                better = value > top[who]
                top[who[better]], choice[who[better]] = value[better], piece[better]
                node = self.link[node]
            best[here + 1], back[here + 1] = top, choice
        at, spans, steps, ids = length.copy(), [], [], []
        live, step = np.arange(len(order)), 0
        while len(live):
            piece = back[cell[live] + at[live]]
            spans.append(live)
            ids.append(piece)
            steps.append(np.full(len(live), -step))
            at[live] -= self.length[piece]
            live, step = live[at[live] > 0], step + 1
        spans, steps, ids = np.concatenate(spans), np.concatenate(steps), np.concatenate(ids)
        spans = order[spans]
        forward = np.lexsort((steps, spans))
        return ids[forward].astype(np.int64), np.searchsorted(spans[forward], np.arange(len(order) + 1))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The streams that ids stand for, and each row's range of bytes."""
        length = self.length[ids]
        ends = np.concatenate(([0], np.cumsum(length)))
        return self.bytes[ranges(self.start[ids], length)], ends[bounds]


def _stream(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a blank put before each that is not empty."""
    filled = np.diff(bounds) > 0
    return np.insert(data, bounds[:-1][filled], 0x20), bounds + np.concatenate(([0], np.cumsum(filled)))


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) for each row of docs (doc_id, text): the model's own ids. Null and empty texts have no ids. Other columns are ignored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model_path)
        for batch in batches:
            for texts in texts_of(batch["text"], CHUNK_BYTES):
                ids, bounds = pieces.encode(*_stream(texts.data, texts.bounds), own=True)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].slice(texts.first, len(texts)), "ids": lists})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) for each row of (doc_id, ids): the text that was encoded, byte for byte. Null ids give an empty text.

    Control and unknown ids stand for nothing; byte pieces that don't make up valid characters are shown as replacement characters.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model_path)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch["ids"].to_pylist()]
            bounds = np.cumsum([0] + [len(x) for x in lists])
            data, edges = pieces.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), bounds)
            texts = [data[a:b].tobytes().decode("utf-8", "replace").removeprefix(" ") for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def piece_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """For each row of docs (doc_id, text): n_ids, n_byte_ids, ids_crc32 (unsigned, of little-endian 32-bit ids), score and round_trip.

    The ids are the model's own; score is the sum of their pieces' scores. round_trip tells whether decoding the ids gives the text's bytes again.
    A null or empty text has no ids and makes the trip.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model_path)
        is_byte = np.zeros(len(pieces.length), bool)
        is_byte[pieces.byte_ids] = True
        for batch in batches:
            for texts in texts_of(batch["text"], CHUNK_BYTES):
                stream, edges = _stream(texts.data, texts.bounds)
                ids, bounds = pieces.encode(stream, edges, own=True)
                again, again_edges = pieces.decode(ids, bounds)
                n = len(texts)
                row = np.repeat(np.arange(n), np.diff(bounds))
                raw = ids.astype("<u4")
                same = [np.array_equal(again[a:b], stream[c:d]) for a, b, c, d in zip(again_edges, again_edges[1:], edges, edges[1:])]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"].slice(texts.first, n), "n_ids": pa.array(np.diff(bounds)),
                    "n_byte_ids": pa.array(np.bincount(row[is_byte[ids]], minlength=n)),
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])], pa.int64()),
                    "score": pa.array(np.bincount(row, weights=pieces.score[ids], minlength=n)), "round_trip": pa.array(same),
                })

    schema = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, score double, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, schema)
