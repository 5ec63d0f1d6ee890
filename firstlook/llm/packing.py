"""Best-fit packing of documents into sequences of fixed capacity.

Only the histogram of piece lengths, as long as the capacity, reaches the driver. Patterns of one to three lengths that fill a sequence are
enumerated, and non-negative least squares finds how often to repeat each so that together they use up the histogram. Counts are rounded
down, and what is left is packed best-fit decreasing, still by counts. Spark then deals each length's pieces out to the places planned for it.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from firstlook.functions.columns import free_name
from firstlook.plans.written import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Runs = tuple[tuple[int, int], ...]
#: The added token of byte_bpe_50k.json, which a file of ranks doesn't name.
SPECIAL = {"<|endoftext|>": 50256}
_encoders: dict[tuple[str, bool], object] = {}


def encoder(path: str, special: bool = False):
    """A function from texts to lists of ids: of a .tiktoken file of ranks by tiktoken, of any other by tokenizers. Made once a process.

    special: the name of a special token in a text is that token, as tokenizers has it by default; otherwise it is text.
    """
    if (path, special) not in _encoders:
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
            bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL if special else {})
            _encoders[path, special] = lambda texts: [bpe.encode(t, allowed_special="all") for t in texts]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = not special
            _encoders[path, special] = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return _encoders[path, special]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole capacities, before them one that may be shorter."""
    first = n if n <= capacity else n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and then end_id, cut into pieces of at most ``capacity``: (doc_id, piece, start, length, ids_crc32[, ids]).

    Special tokens that a text names are single ids. A row for each piece of each row; other columns are ignored. A null or empty text is one piece with end_id alone.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer_path, special=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode_all([t or "" for t in part["text"].to_pylist()])):
                    ids = np.array([*ids, end_id], "<u4")
                    rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), ids[s : s + n]) for k, (s, n) in enumerate(cut(len(ids), capacity))]
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                if keep_ids:
                    arrays.append(pa.array(columns[5], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, PIECES + ", ids array<long>" * keep_ids)


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three lengths, descending and padded with 0, that are present and sum to the capacity."""
    here = np.zeros(capacity + 1, bool)
    here[present] = True
    found = [np.array([[capacity, 0, 0]])] if here[capacity] else []
    a = present[present < capacity]
    pair = a[(2 * a >= capacity) & here[np.maximum(capacity - a, 0)]]
    found.append(np.stack([pair, capacity - pair, 0 * pair], axis=1))
    for largest in a[3 * a >= capacity]:
        b = present[(present <= largest) & (2 * present >= capacity - largest) & (present < capacity - largest)]
        b = b[here[capacity - largest - b]]
        found.append(np.stack([0 * b + largest, b, capacity - largest - b], axis=1))
    return np.concatenate(found)


def repeats(table: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients: how often to use each pattern (a row of lengths).

    A miss weighs as the square of its length: short pieces that are left over find a place later, long ones don't.
    """
    size, flat = len(histogram), table.ravel()
    target = histogram.astype(float)
    target[0] = 0
    weight = (np.arange(size) / size) ** 2

    def uses(x):
        total = np.bincount(flat, weights=np.repeat(x, table.shape[1]), minlength=size)
        total[0] = 0
        return total

    def back(r):
        return (weight * r)[table].sum(1)

    probe = np.ones(len(table))
    for _ in range(15):
        probe = back(uses(probe))
        bound = np.linalg.norm(probe)
        probe /= bound
    x = ahead = np.zeros(len(table))
    speed = 1.0
    for _ in range(steps):
        new = np.maximum(0, ahead - back(uses(ahead) - target) / bound)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = new + (speed - 1) / faster * (new - x)
        x, speed = new, faster
    return x


def _runs(lengths) -> Runs:
    lengths = [n for n in lengths if n]
    return tuple((n, lengths.count(n)) for n in dict.fromkeys(lengths))


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[Runs, int]]:
    """(contents, how many sequences of it); contents are (length, how many). Uses each length exactly as often as it occurs."""
    left = histogram.astype(np.int64).copy()
    present = np.flatnonzero(left)
    planned: list[tuple[Runs, int]] = []
    table = patterns(present, capacity) if len(present) else np.zeros((0, 3), int)
    if len(table):
        often = repeats(table, left)
        used = np.flatnonzero(often >= 1)
        for k in used[np.lexsort((-often[used], -table[used, 0]))]:
            runs = _runs(table[k].tolist())
            times = min(int(often[k]), *(int(left[n]) // m for n, m in runs))
            if times > 0:
                planned.append((runs, times))
                for n, m in runs:
                    left[n] -= m * times
    return planned + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[Runs, int]]:
    """Best-fit decreasing for a histogram: sequences with equal contents are handled together."""
    groups: dict[int, list[list]] = {}
    room = np.zeros(capacity + 1, bool)

    def put(free: int, runs: Runs, times: int) -> None:
        if times:
            groups.setdefault(free, []).append([runs, times])
            room[free] = True

    for n in np.flatnonzero(left)[::-1].tolist():
        waiting = int(left[n])
        while waiting:
            fits = np.flatnonzero(room[n:])
            if not len(fits):
                many = capacity // n
                put(capacity - many * n, ((n, many),), waiting // many)
                if waiting % many:
                    put(capacity - waiting % many * n, ((n, waiting % many),), 1)
                break
            free = n + int(fits[0])
            runs, times = groups[free].pop()
            room[free] = bool(groups[free])
            many = min(free // n, waiting)
            used = min(times, waiting // many)
            put(free, runs, times - used)
            put(free - many * n, (*runs, (n, many)), used)
            waiting -= used * many
    return [(runs, times) for some in groups.values() for runs, times in some]


def _places(planned: list[tuple[Runs, int]]) -> np.ndarray:
    """Rows (length, first rank, sequence, places in a sequence, offset): where the pieces of each length go, by rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for runs, times in planned:
        offset = 0
        for n, many in runs:
            rows.append((n, taken.get(n, 0), sequence, many, offset))
            taken[n] = taken.get(n, 0) + many * times
            offset += n * many
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(lengths: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """The rows with sequence_id and offset: no sequence is longer than ``capacity``, and none has a gap.

    Takes rows with length (1 to capacity); order names columns that tell rows apart. Equal rows are packed as often as they occur. Other columns
    may have any names; a sequence_id or offset that is there already gives way to the new one. Rows
    are numbered within each length by way of counts of (length, part of a hash), so that a frequent length is spread over many tasks.
    """
    spark = lengths.sparkSession
    counts = lengths.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row for each length: at most the capacity
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts:
        histogram[r.length] = r.n
    places = _places(plan(histogram, capacity))
    keys = (places[:, 0] << 44) + places[:, 1]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(histogram.sum() >> 20))
    lengths = lengths.drop("sequence_id", "offset")
    part, n, before, rank = (free_name(lengths, x) for x in ("_part", "_n", "_before", "_rank"))
    dealt = lengths.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)))
    earlier = (
        dealt.groupBy("length", part).agg(F.count("*").alias(n))
        .withColumn(before, F.sum(n).over(Window.partitionBy("length").orderBy(part)) - F.col(n)).drop(n)
    )
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy("length", part).orderBy(*order)) - 1)
    ranked = ranked.join(earlier, ["length", part]).withColumn(rank, F.col(rank) + F.col(before)).drop(part, before)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = batch["length"].to_numpy(), batch[rank].to_numpy()
            at = np.searchsorted(keys, (length << 44) + nth, "right") - 1
            _, first, sequence, many, offset = places[at].T
            nth = nth - first
            kept = batch.drop_columns([rank])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence + nth // many), pa.array(offset + nth % many * length)], names=[*kept.schema.names, "sequence_id", "offset"]
            )

    schema = ranked.drop(rank).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) as packed pieces; the pieces are written once, since they are counted before they are placed.

    Null or empty texts give a piece with the end id alone; null ids stay null; repeated rows are packed as often as they occur; an empty
    table gives no rows.
    """
    return pack(written(pieces(docs, tokenizer_path, capacity, keep_ids=keep_ids)), capacity, ["doc_id", "piece", "ids_crc32"])


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed pieces' ids put together; a sequence holds at most the capacity, so a group is small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
