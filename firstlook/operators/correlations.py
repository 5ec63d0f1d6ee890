"""Pearson correlation of every pair of numeric columns."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import q
from .stats import numeric_table
from .types import NUMERIC, groupable, infer_types

MIN_ABS_R = 0.5
PAIRS_IN_FUNCTIONS = 400
SUMS = ["rows", "x", "y", "xx", "yy", "xy"]
EMPTY = "a string, b string, r double"


def pearson(a: Column, b: Column, complete: bool = False) -> Column:
    """r over the rows where both are present; NULL when either is constant there.

    Built from the covariance because ``corr`` fails on a constant column under ANSI rules. Columns
    known to be ``complete`` skip the masks, so each deviation is computed once for all pairs.
    """
    x = a if complete else F.when(b.isNotNull(), a)
    y = b if complete else F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(
    df: DataFrame, names: list[str] | None = None, min_abs_r: float = MIN_ABS_R
) -> DataFrame:
    """Rows (a, b, r) with a < b and |r| >= ``min_abs_r``, strongest first.

    All pairs come from one pass over the table: from one aggregate of built-in functions, or, if there are more pairs than such an
    aggregate can well hold, from products of the columns as matrices.
    """
    names = groupable(df, infer_types(df), *NUMERIC) if names is None else names
    pairs = list(combinations(sorted(names), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], EMPTY)
    numeric = numeric_table(df, sorted(names))
    found = _by_functions(numeric, pairs) if len(pairs) <= PAIRS_IN_FUNCTIONS else _by_products(numeric)
    return found.where(F.abs("r") >= min_abs_r).orderBy(F.abs("r").desc(), "a", "b")


def _by_functions(numeric: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    gaps = numeric.agg(*[F.count_if(q(n).isNull()).alias(f"g{i}") for i, n in enumerate(numeric.columns)]).first()
    whole = {n for i, n in enumerate(numeric.columns) if gaps[f"g{i}"] == 0}
    rs = numeric.agg(*[
        pearson(q(a), q(b), complete=a in whole and b in whole).alias(f"r{i}") for i, (a, b) in enumerate(pairs)
    ])
    return rs.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)
    ])))


def _by_products(numeric: DataFrame) -> DataFrame:
    """(a, b, r) from sums over the rows where both are present: rows, values, squares and products, each a product of two matrices.

    A task sends one row for each pair. Values are taken from the columns' means, which keeps the sums small; a pair in which one column is
    constant but for rounding has no r.
    """
    names = numeric.columns
    means = numeric.agg(*[F.avg(q(n)).alias(f"m{i}") for i, n in enumerate(names)]).first()
    shift = np.array([0.0 if m is None else m for m in means])
    first, second = np.triu_indices(len(names), 1)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = values = squares = products = np.zeros((len(names), len(names)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)
            rows, values, squares, products = rows + there.T @ there, values + x.T @ there, squares + (x * x).T @ there, products + x.T @ x
        at, back = (first, second), (second, first)
        sums = [rows[at], values[at], values[back], squares[at], squares[back], products[at]]
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), *map(pa.array, sums)], names=["i", "j", *SUMS])

    parts = numeric.mapInArrow(added, "i long, j long, " + ", ".join(f"{s} double" for s in SUMS))
    total = parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])

    def spread(square: str, value: str) -> Column:
        around = F.col(square) - F.try_divide(F.col(value) * F.col(value), F.col("rows"))
        return F.when(around > 1e-12 * F.col(square), around)

    shared = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("rows"))
    label = F.array(*[F.lit(n) for n in names])
    r = F.nanvl(shared / F.sqrt(spread("xx", "x") * spread("yy", "y")), F.lit(None).cast("double"))
    return total.select(label[F.col("i").cast("int")].alias("a"), label[F.col("j").cast("int")].alias("b"), r.alias("r"))
