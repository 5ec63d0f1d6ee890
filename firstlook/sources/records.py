"""Rows as JSON records, and a bounded preview of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import REAL_TYPES, TIME_TYPES, data_type, q
from ..functions.dates import iso_text
from ..operators.sample import exact_sample
from .order import ROW_ORDER

# Fixed values of the preview.
DEFAULT_ROWS = 5_000
MOST_ROWS = 50_000


def json_value(df: DataFrame, name: str) -> Column:
    """A cell as JSON can hold it, at any depth: no NaN or infinity, timestamps in ISO form."""
    return _json_value(q(name), data_type(df, name))


def _json_value(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, REAL_TYPES):
        return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)
    if isinstance(dtype, TIME_TYPES):
        return iso_text(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _json_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: _json_value(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_json_value(col[f.name], f.dataType).alias(f.name) for f in dtype]))
    return col


def records(df: DataFrame) -> DataFrame:
    """One JSON object per row, in column ``record``; every column appears, missing values as null."""
    cells = [json_value(df, c).alias(c) for c in df.columns if c != ROW_ORDER]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("record"))


@dataclass
class Preview:
    columns: list[str]
    total_rows: int
    returned_rows: int
    sampled: bool
    records: DataFrame


def preview(df: DataFrame, order_by: str, limit: int = DEFAULT_ROWS) -> Preview:
    """All rows of a small table, else an exact sample of ``limit`` rows, in row order."""
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must lie between 1 and {MOST_ROWS}")
    total = df.count()
    returned = min(limit, total)
    columns = [c for c in df.columns if c != ROW_ORDER]
    return Preview(columns, total, returned, returned < total, records(exact_sample(df, limit, order_by, rows=total)))
