"""Column statistics by semantic type, as long tables (column, stat, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import as_label, as_number, data_type, nan_to_null, q
from ..functions.dates import as_datetime, elapsed_days, iso_text
from ..plans.counts import top_values
from ..plans.quantiles import quantiles
from ..plans.reuse import reused
from .types import CATEGORY, NUMERIC, columns_of, distinct_key, groupable, infer_types

# Fixed values of the outlier rule.
FENCE = 1.5
MIN_ROWS_FOR_OUTLIERS = 4
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
NUMERIC_STATS = ["count", "mean", "median", "std", "min", "max", "q25", "q75", "skew", "outliers_iqr"]


def overview(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """One row per semantic type, with the table's row and column counts."""
    types = types or infer_types(df)
    kinds = sorted(set(types.values()))
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    tally = F.array(*[
        F.struct(F.lit(k).alias("semantic_type"), F.lit(len(columns_of(types, k))).cast("long").alias("columns"))
        for k in kinds
    ])
    return rows.select("rows", F.lit(len(types)).cast("long").alias("cols"), F.inline(tally))


def adjusted_skew(col: Column) -> Column:
    """Bias-adjusted skewness; NULL under three values, 0 for a constant column."""
    n = F.count(col).cast("double")
    adjusted = F.try_divide(F.skewness(col) * F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.coalesce(adjusted, F.lit(0.0)))


def numeric_table(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as doubles, with NaN and text that is no number as NULL."""
    return df.select(*[as_number(q(n), data_type(df, n)).alias(n) for n in names])


def numeric_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per numeric column: (column, count, mean, median, std, min, max, q25, q75, skew, outliers_iqr).

    Moments, sketches, exact quartiles and outliers are four passes over the same few columns, however many
    there are: the first and the last compile to tight loops, which sketches would prevent.
    """
    spark = df.sparkSession
    schema = "column string, count long, " + ", ".join(f"{s} double" for s in NUMERIC_STATS[1:-1]) + ", outliers_iqr long"
    if not names:
        return spark.createDataFrame([], schema)
    with reused(numeric_table(df, names)) as numeric:
        return spark.createDataFrame(_numeric_rows(numeric, names), schema)


def _numeric_rows(numeric: DataFrame, names: list[str]) -> list[tuple]:
    moments: list[Column] = []
    for i, name in enumerate(names):
        col = q(name)
        moments += [
            F.count(col).alias(f"count{i}"), F.avg(col).alias(f"mean{i}"), F.stddev_samp(col).alias(f"std{i}"),
            F.min(col).alias(f"min{i}"), F.max(col).alias(f"max{i}"), adjusted_skew(col).alias(f"skew{i}"),
        ]
    row = numeric.agg(*moments).first()
    rows = {n: row[f"count{i}"] for i, n in enumerate(names)}
    found = quantiles(numeric, names, list(QUARTILES.values()))

    outside: list[Column] = []
    for i, name in enumerate(names):
        low, high = fences(rows[name], found[name, QUARTILES["q25"]], found[name, QUARTILES["q75"]])
        outlying = (q(name) < low) | (q(name) > high) if low is not None else F.lit(False)
        outside.append(F.count_if(outlying).alias(str(i)))
    outliers = numeric.agg(*outside).first()

    def stat(name: str, i: int, label: str) -> float | None:
        value = found[name, QUARTILES[label]] if label in QUARTILES else row[f"{label}{i}"]
        return value if value is None or math.isfinite(value) else None

    return [
        (name, rows[name], *[stat(name, i, s) for s in NUMERIC_STATS[1:-1]], outliers[str(i)] if rows[name] else None)
        for i, name in enumerate(names)
    ]


def fences(rows: int, q25: float | None, q75: float | None) -> tuple[float | None, float | None]:
    """Values outside these limits are outliers; no limits for few rows or a zero quartile range."""
    if rows < MIN_ROWS_FOR_OUTLIERS or q25 is None or q75 is None or q75 == q25:
        return None, None
    reach = FENCE * (q75 - q25)
    return q25 - reach, q75 + reach


def outliers(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows (column, count, outliers_iqr)."""
    return numeric_stats(df, names).select("column", "count", "outliers_iqr")


def categorical_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per category column: (column, count, unique, top, top_count, top_pct)."""
    return top_values(df, names).select(
        "column",
        F.col("rows").alias("count"),
        "unique",
        "top",
        "top_count",
        (F.col("top_count") / F.col("rows") * 100.0).alias("top_pct"),
    )


def text_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per text column: (column, count, unique, avg_length, max_length)."""
    cells = [F.struct(distinct_key(c).alias("key"), F.length(c).alias("length"))
             for c in (as_label(q(n), data_type(df, n)) for n in names)]
    wide = df.select(*[F.when(cell["key"].isNotNull(), cell).alias(n) for n, cell in zip(names, cells)])
    long = wide.unpivot([], [q(n) for n in names], "column", "cell").where("cell is not null")
    return long.groupBy("column").agg(
        F.count("cell").alias("count"),
        F.count_distinct("cell.key").alias("unique"),
        F.avg("cell.length").alias("avg_length"),
        F.max("cell.length").cast("double").alias("max_length"),
    )


def datetime_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per date column: (column, count, min, max, span_days)."""
    dates = df.select(*[as_datetime(q(n), data_type(df, n)).alias(n) for n in names])
    ends = dates.agg(
        *[agg(q(n)).alias(f"{label}{i}") for i, n in enumerate(names)
          for label, agg in (("n", F.count), ("a", F.min), ("z", F.max))]
    )
    return ends.select(F.inline(F.array(*[
        F.struct(
            F.lit(n).alias("column"),
            F.col(f"n{i}").alias("count"),
            iso_text(F.col(f"a{i}")).alias("min"),
            iso_text(F.col(f"z{i}")).alias("max"),
            elapsed_days(F.col(f"a{i}"), F.col(f"z{i}")).alias("span_days"),
        )
        for i, n in enumerate(names)
    ])))


def column_stats(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Statistics of every column in long form: (column, semantic_type, stat, number, label)."""
    df = nan_to_null(df)
    types = types or infer_types(df)
    parts: list[DataFrame] = []
    groups = [
        (numeric_stats, groupable(df, types, *NUMERIC)),
        (categorical_stats, groupable(df, types, *CATEGORY)),
        (text_stats, groupable(df, types, "text")),
        (datetime_stats, groupable(df, types, "datetime")),
    ]
    for compute, names in groups:
        if not names:
            continue
        wide = compute(df, names)
        entries = []
        for f in wide.schema.fields[1:]:
            is_text = isinstance(f.dataType, T.StringType)
            entries.append(F.struct(
                F.lit(f.name).alias("stat"),
                (F.lit(None) if is_text else q(f.name)).cast("double").alias("number"),
                (q(f.name) if is_text else F.lit(None)).cast("string").alias("label"),
            ))
        parts.append(wide.select("column", F.inline(F.array(*entries))))
    return _with_types(df.sparkSession, parts, types)


def _with_types(spark: SparkSession, parts: list[DataFrame], types: dict[str, str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], "column string, semantic_type string, stat string, number double, label string")
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    kind = F.create_map(*[F.lit(v) for pair in types.items() for v in pair])
    return long.select("column", F.element_at(kind, F.col("column")).alias("semantic_type"), "stat", "number", "label")


def stats_report(df: DataFrame, types: dict[str, str]) -> dict[str, dict]:
    """Column name -> {type, stats}; the driver sees one small row per column."""
    df = nan_to_null(df)
    found: dict[str, dict] = {}
    for compute, kinds in (
        (numeric_stats, NUMERIC), (categorical_stats, CATEGORY), (text_stats, ("text",)), (datetime_stats, ("datetime",)),
    ):
        names = groupable(df, types, *kinds)
        for row in compute(df, names).collect() if names else []:
            stats = row.asDict()
            found[stats.pop("column")] = stats if stats["count"] else {"count": 0}
    empty = {"count": 0, "unique": 0}
    report = {}
    for name, kind in types.items():
        missing = empty if kind in (*CATEGORY, "text") else {"count": 0}
        report[name] = {"type": kind, "stats": found.get(name, missing)}
    return report
