"""An exact number of rows, drawn the same way every time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import free_name, q
from ..plans.written import written

SEED = 42
HEX_DIGITS = 15
HASH_SPAN = 16**HEX_DIGITS


def row_hash(key: str, seed: int = SEED) -> Column:
    """Pseudo-random position of a row below 2**60, fixed by its key as text and the seed: 15 hex digits of their MD5."""
    return F.conv(_place(key, seed), 16, 10).cast("long")


def _place(key: str, seed: int) -> Column:
    """The position as its hex digits, which sort as the number does and need not become one."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}|"), q(key).cast("string"))), 1, HEX_DIGITS)


def exact_sample(df: DataFrame, limit: int, key: str, seed: int = SEED, rows: int | None = None, ordered: bool = True) -> DataFrame:
    """``limit`` rows without replacement, in ``key`` order; the whole table when it has no more.

    The rows with the lowest hashes win. A cut that leaves slightly more than ``limit`` rows comes
    first, and what it leaves is written, so that one pass both counts and keeps them and the final sort sees about ``limit`` rows. If
    there are too few, which takes keys that repeat, the cut is widened; the size is exact. ``key`` is unique.
    """
    total = df.count() if rows is None else rows
    if total <= limit:
        return df.orderBy(q(key)) if ordered else df
    place, spare = free_name(df, "_place"), limit + 10 * math.isqrt(limit) + 100
    candidates = df.withColumn(place, _place(key, seed))
    while (cut := math.ceil(HASH_SPAN * min(1.0, spare / total))) < HASH_SPAN:
        few = candidates.where(q(place) < F.lit(f"{cut:0{HEX_DIGITS}x}"))
        few = written(few) if _can_be_written(few) else few
        if few.count() >= limit:
            candidates = few
            break
        spare *= 4
    picked = candidates.orderBy(q(place), q(key)).limit(limit).drop(place)
    return picked.orderBy(q(key)) if ordered else picked


def _can_be_written(df: DataFrame) -> bool:
    """Whether Parquet holds the rows: names that differ by more than case, and no type of its own for nothing or for a span of time."""
    odd = (T.NullType, T.CalendarIntervalType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.VariantType)
    return len({c.lower() for c in df.columns}) == len(df.columns) and not any(isinstance(f.dataType, odd) for f in df.schema)
