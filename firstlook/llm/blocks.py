"""Questions that blocks of documents put to the whole corpus.

Documents are dealt into blocks of bounded size by a hash of the row. A block names things in its texts by 64-bit fingerprints and asks about
each distinct one once; names are dealt into buckets by value, each bucket sees all blocks' questions about its names, and its answers go
back to the block. Names travel sorted and packed, so a shuffle moves 5 to 8 bytes for each.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

BLOCK_BYTES = 4 << 20
BUCKET_NAMES = 500_000
ASKED = "bucket long, block long, kind int, names binary, extra binary"
ANSWERED = "block long, bucket long, kind int, answer binary"


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, rest: bool = False) -> tuple[DataFrame, int]:
    """(doc_id, text, block[, rest]) and the number of blocks: about block_bytes of text in each; rest is a struct of the other columns.

    A text is never cut, so one that is longer makes a block as long. Equal rows share a block; null ids and texts are dealt like others.
    """
    others = [F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("rest")] if rest else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *others)
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = int(total // block_bytes) + 1
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count))), count


def buckets_for(blocks: int, names_a_byte: float, block_bytes: int = BLOCK_BYTES) -> int:
    """How many buckets keep each near BUCKET_NAMES names."""
    return int(blocks * block_bytes * names_a_byte // BUCKET_NAMES) + 1


def bucket_edges(names: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's names start in sorted ones."""
    return np.searchsorted(_bucket(names, buckets), np.arange(buckets + 1))


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, none negative, in as few bytes each as the largest needs."""
    values = values.astype("<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    flat = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(flat), 8), np.uint8)
    full[:, :width] = flat
    return full.view("<u8").ravel()


def packed_names(names: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as the first and the gaps."""
    return names[:1].tobytes() + packed(np.diff(names)) if len(names) else b""


def unpacked_names(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1), unpacked(data[8:])]), dtype=np.uint64)


def questions(block: int, kind: int, names: np.ndarray, extra: np.ndarray | None, buckets: int, all_buckets: bool = False) -> list[tuple]:
    """Rows of ASKED for ascending names, with a number about each."""
    edges = bucket_edges(names, buckets)
    some = range(buckets) if all_buckets else np.flatnonzero(np.diff(edges)).tolist()
    cut = lambda b: slice(edges[b], edges[b + 1])
    return [(b, block, kind, packed_names(names[cut(b)]), packed(extra[cut(b)]) if extra is not None else b"") for b in some]


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    """Rows as an Arrow table under a Spark schema string of longs, ints, doubles, booleans, strings and binaries."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def texts_in(table: pa.Table) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of a block, chunk by chunk of its column."""
    at = 0
    for chunk in table["text"].chunks:
        yield at, chunk
        at += len(chunk)


def _freed(table: pa.Table) -> pa.Table:
    """The table, after Arrow's pool and the allocator of numpy have given back what earlier groups left: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
    return table


def _trim():
    """glibc's function that returns free memory to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


_TRIM = _trim()


def ask(blocks: DataFrame, asking: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """Each block's questions: asking gives rows of ASKED."""
    return blocks.groupBy("block").applyInArrow(lambda table: _freed(table_of(asking(table), ASKED)), ASKED)


def answer(asked: DataFrame, answering: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """Each bucket's answers: answering gives rows of ANSWERED."""
    return asked.groupBy("bucket").applyInArrow(lambda table: _freed(table_of(answering(table), ANSWERED)), ANSWERED)


def told(blocks: DataFrame, answers: DataFrame, using: Callable[[pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """What each block makes of its texts and the answers to it. Only blocks with texts are ever answered."""

    def use(texts: pa.Table, answers: pa.Table) -> pa.Table:
        return _freed(using(texts, answers))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(use, schema)
