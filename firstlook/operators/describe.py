"""A compact description of a table, for a person or a language model."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_label, as_number, data_type, nan_to_null, q
from ..functions.dates import as_datetime
from ..plans.counts import labels_long
from ..sources.order import ROW_ORDER
from .types import CATEGORY, NUMERIC, groupable, profile

# Fixed values of the description.
SHOWN_VALUES = 8
SHOWN_TEXT = 30
SAMPLE_ROWS = 3


def first_values(df: DataFrame, names: list[str], order_by: str, limit: int = SHOWN_VALUES) -> DataFrame:
    """Rows (column, rank, value): the first distinct values of each column in row order.

    Values meet map-side with their earliest position, and each task keeps the first few per column
    before the ranks are made.
    """
    ordered = df.select(q(order_by).alias("_at"), *[as_label(q(n), data_type(df, n)).alias(n) for n in names])
    earliest = labels_long(ordered, names, keep=["_at"]).groupBy("column", "value").agg(F.min("_at").alias("_at"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("_at"))
    return earliest.withColumn("rank", rank).where(F.col("rank") <= limit).select("column", "rank", "value")


def column_details(df: DataFrame, types: dict[str, str], order_by: str) -> DataFrame:
    """Rows (column, semantic_type, detail): range, date range, first values or a first text."""
    df = nan_to_null(df)
    numerics = groupable(df, types, *NUMERIC)
    dates = groupable(df, types, "datetime")
    texts = groupable(df, types, "text")
    categories = groupable(df, types, *CATEGORY)
    spark = df.sparkSession
    parts: list[DataFrame] = []

    one_row: list[Column] = []
    details: list[Column] = []
    for i, name in enumerate(numerics):
        value = as_number(q(name), data_type(df, name))
        one_row += [F.min(value).alias(f"n{i}a"), F.max(value).alias(f"n{i}z")]
        details.append(_detail(name, F.concat(F.col(f"n{i}a").cast("string"), F.lit(".."), F.col(f"n{i}z").cast("string"))))
    for i, name in enumerate(dates):
        value = as_datetime(q(name), data_type(df, name))
        one_row += [F.min(value).alias(f"d{i}a"), F.max(value).alias(f"d{i}z")]
        days = [F.date_format(F.col(f"d{i}{end}"), "yyyy-MM-dd") for end in "az"]
        details.append(_detail(name, F.concat(days[0], F.lit(".."), days[1])))
    for i, name in enumerate(texts):
        text = q(name).cast("string")
        one_row.append(F.min_by(text, F.when(text.isNotNull(), q(order_by))).alias(f"t{i}"))
        first = F.col(f"t{i}")
        short = F.concat(F.substring(first, 1, SHOWN_TEXT), F.lit("..."))
        details.append(_detail(name, F.when(F.length(first) > SHOWN_TEXT, short).otherwise(first)))
    if details:
        parts.append(df.agg(*one_row).select(F.inline(F.array(*details))))
    if categories:
        shown = first_values(df, categories, order_by).groupBy("column").agg(
            F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("shown")
        )
        parts.append(shown.select("column", F.to_json(F.col("shown.value")).alias("detail")))
    known = spark.createDataFrame(
        [(i, c, k) for i, (c, k) in enumerate(types.items())], "position int, column string, semantic_type string"
    )
    if not parts:
        return known.withColumn("detail", F.lit(None).cast("string"))
    detail = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return known.join(detail, "column", "left").select("position", "column", "semantic_type", "detail")


def _detail(name: str, text: Column) -> Column:
    return F.struct(F.lit(name).alias("column"), text.alias("detail"))


def _short_number(text: str) -> str:
    return f"{float(text):.4g}"


def describe(df: DataFrame, order_by: str, types: dict[str, str] | None = None, sample_rows: int = SAMPLE_ROWS) -> str:
    """Rows, columns with their types and ranges, and the first rows, as text."""
    from ..sources.records import records

    data = df.select(*[q(c) for c in df.columns if c != ROW_ORDER])
    known = profile(data)
    types = types or known.types
    lines = []
    for row in column_details(df, types, order_by).orderBy("position").collect():
        kind, detail = row["semantic_type"], row["detail"]
        line = f"  {row['column']} ({kind})"
        if detail is not None:
            if kind in NUMERIC:
                low, high = (_short_number(end) for end in detail.split(".."))
                line += f", range {low}..{high}"
            elif kind == "datetime":
                line += f", range {detail}"
            elif kind in CATEGORY:
                line += f", values: {json.loads(detail)}"
            else:
                line += f", sample: '{detail}'"
        lines.append(line)
    first = records(df.orderBy(q(order_by)).limit(sample_rows)).collect()
    sample = json.dumps([json.loads(r["record"]) for r in first], indent=2, ensure_ascii=False)
    columns = "\n".join(lines) or "  (no columns)"
    return (
        f"The table has {known.rows} rows and {len(types)} columns.\nColumns:\n{columns}\n\n"
        f"Sample rows ({sample_rows}):\n{sample}"
    )
