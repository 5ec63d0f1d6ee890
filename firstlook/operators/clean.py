"""Cleaning: trim, rename, de-duplicate, drop sparse columns, fill what is missing, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from ..functions.columns import (
    TEXT_TYPES, WHOLE_TYPES, as_number, data_type, is_nested, nan_to_null, q,
)
from ..functions.dates import as_datetime
from ..functions.text import snake_names, trim_space
from ..plans.counts import top_values
from ..plans.ordered import OrderError, fill_in_order
from ..plans.quantiles import quantiles
from ..plans.written import written
from ..sources.order import ROW_ORDER
from .types import CATEGORY, NUMERIC, columns_of, profile

# Fixed values of the cleaning rules.
SPARSE_SHARE = 0.6
TEXT_FILL = "unknown"


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the technical row order."""
    return [c for c in df.columns if c != ROW_ORDER]


def trim_cells(df: DataFrame) -> DataFrame:
    """Trim white space of every string cell; other types stay as they are."""
    return df.select(
        *[trim_space(q(f.name)).alias(f.name) if isinstance(f.dataType, TEXT_TYPES) else q(f.name) for f in df.schema]
    )


def rename_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Snake-case, unique column names, and the map from old to new names."""
    data = data_columns(df)
    renamed = snake_names(data)
    # By position: names that differ only by case cannot be told apart in a select.
    fresh = iter(renamed)
    return df.toDF(*[c if c == ROW_ORDER else next(fresh) for c in df.columns]), dict(zip(data, renamed))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Drop fully equal rows; the first in row order stays when the table has a row order.

    Copies collapse before the shuffle, so many copies of one row cost one row per task.
    """
    data = data_columns(df)
    if ROW_ORDER not in df.columns:
        return df.dropDuplicates()
    return df.groupBy(*[q(c) for c in data]).agg(F.min(ROW_ORDER).alias(ROW_ORDER)).select(*[q(c) for c in df.columns])


def null_profile(df: DataFrame) -> DataFrame:
    """Rows (column, nulls, null_ratio), from one aggregate."""
    data = data_columns(df)
    clean = nan_to_null(df)
    counts = clean.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(q(c).isNull()).alias(c) for c in data]
    )
    ratio = F.when(F.col("_rows") == 0, 0.0).otherwise(F.col("nulls") / F.col("_rows"))
    return counts.unpivot(["_rows"], [q(c) for c in data], "column", "nulls").select(
        "column", "nulls", ratio.alias("null_ratio")
    )


def sparse_columns(nulls: dict[str, int], rows: int) -> list[str]:
    """Columns whose share of missing values is strictly above the limit."""
    return [c for c, n in nulls.items() if rows and n / rows > SPARSE_SHARE]


def drop_sparse(df: DataFrame) -> DataFrame:
    """Drop the columns that are mostly missing."""
    sparse = null_profile(df).where(F.col("null_ratio") > SPARSE_SHARE).select("column").collect()
    return df.drop(*[r["column"] for r in sparse])


def medians(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    """Exact medians of numeric columns."""
    if not names:
        return {}
    numeric = df.select(*[as_number(q(n), data_type(df, n)).alias(n) for n in names])
    return {name: value for (name, _), value in quantiles(numeric, names, [0.5]).items()}


def modes(df: DataFrame, names: list[str]) -> dict[str, str | None]:
    """Most frequent value per column, as text; the smallest wins a tie."""
    if not names:
        return {}
    found = {r["column"]: r["top"] for r in top_values(df, names).select("column", "top").collect()}
    return {n: found.get(n) for n in names}


def _fill_number(df: DataFrame, name: str, median: float | None, nulls: int) -> tuple[Column, str]:
    """Numbers stored as text become numbers; whole numbers stay whole unless a fraction has to go in."""
    dtype = data_type(df, name)
    if median is None:
        return q(name), "left empty (no non-null values to compute median)"
    action = f"filled with median ({median})"
    value = as_number(q(name), dtype) if isinstance(dtype, TEXT_TYPES) else q(name)
    if not nulls:
        return value, action
    if isinstance(dtype, WHOLE_TYPES) and float(median).is_integer():
        return F.coalesce(value, F.lit(int(median)).cast(dtype)), action
    return F.coalesce(value.cast("double"), F.lit(median)), action


def _fill_category(df: DataFrame, name: str, mode: str | None) -> tuple[Column, str]:
    if mode is None:
        return F.coalesce(q(name).cast("string"), F.lit(TEXT_FILL)), f"filled with constant '{TEXT_FILL}'"
    return F.coalesce(q(name), F.lit(mode).cast(data_type(df, name))), f"filled with mode ('{mode}')"


@dataclass
class Filled:
    table: DataFrame
    actions: dict[str, str]
    dropped: list[str]
    coerced_to_null: dict[str, int]


def fill_missing(
    df: DataFrame,
    types: dict[str, str],
    nulls: dict[str, int] | None = None,
    rows: int | None = None,
    order_by: str | None = None,
) -> Filled:
    """Fill by semantic type: median, mode, constant text, or the date before.

    Fill values come from three small aggregates. Only date columns that have gaps need the row
    order, and only they make the table shuffle.
    """
    if nulls is None or rows is None:
        known = profile(df)
        nulls, rows = known.nulls, known.rows
    data = data_columns(df)
    order_by = order_by or (ROW_ORDER if ROW_ORDER in df.columns else None)
    dropped = sparse_columns({c: nulls[c] for c in data}, rows)
    actions = {c: f"dropped ({nulls[c] / rows:.0%} null)" for c in dropped}
    kept = {c: types.get(c, "text") for c in data if c not in dropped}

    plain = {c: kind for c, kind in kept.items() if not is_nested(data_type(df, c))}
    median_of = medians(df, columns_of(plain, *NUMERIC))
    mode_of = modes(df, columns_of(plain, *CATEGORY))
    dates = columns_of(plain, "datetime")
    parsed = {c: as_datetime(q(c), data_type(df, c)) for c in dates}
    coerced = {c: 0 for c in dates}
    if text_dates := [c for c in dates if isinstance(data_type(df, c), TEXT_TYPES)]:
        lost = df.agg(*[(F.count(q(c)) - F.count(parsed[c])).alias(f"l{i}") for i, c in enumerate(text_dates)]).first()
        coerced.update({c: lost[f"l{i}"] for i, c in enumerate(text_dates)})

    chosen: list[Column] = []
    for name, kind in kept.items():
        if name not in plain:
            value, actions[name] = q(name), "left as is (nested values)"
        elif kind in NUMERIC:
            value, actions[name] = _fill_number(df, name, median_of[name], nulls[name])
        elif kind in CATEGORY:
            value, actions[name] = _fill_category(df, name, mode_of[name])
        elif kind == "datetime":
            value, actions[name] = parsed[name], "forward-filled (with backfill fallback)"
        else:
            value = F.coalesce(q(name).cast("string"), F.lit(TEXT_FILL))
            actions[name] = f"filled with constant '{TEXT_FILL}'"
        chosen.append(value.alias(name))

    hidden = [order_by] if order_by and order_by not in kept else []
    table = df.select(*chosen, *[q(c) for c in hidden])
    gaps = [c for c in dates if nulls[c] + coerced[c] > 0]
    if gaps:
        if order_by is None:
            raise ValueError(f"filling the dates of {', '.join(gaps)} needs a row order: pass order_by")
        if nulls.get(order_by):  # they may have a value by now, if the order is data itself
            raise OrderError(f"the order column '{order_by}' has missing values")
        table = fill_in_order(table, gaps, order_by, checked=order_by != ROW_ORDER)
    keep_order = [ROW_ORDER] if ROW_ORDER in hidden else []
    return Filled(
        table.select(*[q(c) for c in kept], *[q(c) for c in keep_order]),
        {c: actions[c] for c in data}, dropped, coerced,
    )


@dataclass
class ColumnReport:
    name: str
    detected_type: str
    nulls_before: int
    nulls_after: int
    action: str
    coerced_to_null: int = 0


@dataclass
class CleaningReport:
    rows_in: int = 0
    rows_out: int = 0
    cols_in: int = 0
    cols_out: int = 0
    duplicates_removed: int = 0
    columns: list[ColumnReport] = field(default_factory=list)
    dropped_columns: list[str] = field(default_factory=list)
    renamed_columns: dict[str, str] = field(default_factory=dict)

    def summary_table(self, spark: SparkSession) -> DataFrame:
        """One row of table counters."""
        schema = (
            "rows_in long, rows_out long, cols_in int, cols_out int, duplicates_removed long, "
            "dropped_columns array<string>, renamed_columns map<string,string>"
        )
        names = [part.split()[0] for part in schema.split(", ")]
        return spark.createDataFrame([tuple(getattr(self, n) for n in names)], schema)

    def columns_table(self, spark: SparkSession) -> DataFrame:
        """One row per column of the input, dropped ones included."""
        schema = (
            "position int, name string, detected_type string, nulls_before long, nulls_after long, "
            "action string, coerced_to_null long"
        )
        rows = [Row(i, c.name, c.detected_type, c.nulls_before, c.nulls_after, c.action, c.coerced_to_null)
                for i, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, schema)


@dataclass
class Cleaned:
    table: DataFrame
    report: CleaningReport


def clean(df: DataFrame, order_by: str | None = None) -> Cleaned:
    """Trim, rename, de-duplicate, infer types, count NULLs, drop and fill, report.

    The de-duplicated table is written once to the shared folder; profile and fill values read from
    there only the columns they need. ``order_by`` names a column that gives the row order; files
    read by this package bring their own.
    """
    rows_in, cols_in = df.count(), len(data_columns(df))
    named, renames = rename_columns(df)
    order_by = renames.get(order_by, order_by)
    distinct = written(drop_duplicates(trim_cells(nan_to_null(named))))
    data = data_columns(distinct)
    known = profile(distinct.select(*[q(c) for c in data]))
    filled = fill_missing(distinct, known.types, known.nulls, known.rows, order_by)

    def nulls_after(name: str) -> int:
        left = filled.actions[name].startswith("left")
        return known.nulls[name] if left and name not in filled.dropped else 0

    report = CleaningReport(
        rows_in=rows_in,
        rows_out=known.rows,
        cols_in=cols_in,
        cols_out=len(data) - len(filled.dropped),
        duplicates_removed=rows_in - known.rows,
        dropped_columns=filled.dropped,
        renamed_columns=renames,
        columns=[
            ColumnReport(
                c, known.types[c], known.nulls[c], nulls_after(c), filled.actions[c],
                filled.coerced_to_null.get(c, 0),
            )
            for c in data
        ],
    )
    return Cleaned(filled.table, report)
