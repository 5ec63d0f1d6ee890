"""Best and worst category by mean, for every pair of category and numeric column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_label, as_number, data_type, q
from .types import CATEGORY, NUMERIC, groupable, infer_types

EMPTY = (
    "category_col string, numeric_col string, top_value string, top_mean double, "
    "bottom_value string, bottom_mean double, pct_diff double"
)


def category_means(df: DataFrame, categories: list[str], numerics: list[str]) -> DataFrame:
    """Rows (category_col, value, numeric_col, mean): every mean of every pair from one grouped job.

    Each row is repeated once per category column and summed map-side, so a category that holds a
    third of the table is a handful of partial rows when it is shuffled.
    """
    measures = [f"_n{i}" for i in range(len(numerics))]
    wide = df.select(
        *[as_label(q(c), data_type(df, c)).alias(f"_c{i}") for i, c in enumerate(categories)],
        *[as_number(q(n), data_type(df, n)).alias(m) for n, m in zip(numerics, measures)],
    )
    long = wide.unpivot(measures, [f"_c{i}" for i in range(len(categories))], "_category", "value")
    means = long.where("value is not null").groupBy("_category", "value").agg(*[F.avg(m).alias(m) for m in measures])
    names = F.create_map(*[F.lit(v) for i, c in enumerate(categories) for v in (f"_c{i}", c)])
    return means.select(
        F.element_at(names, F.col("_category")).alias("category_col"),
        "value",
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("numeric_col"), F.col(m).alias("mean")) for n, m in zip(numerics, measures)
        ])),
    ).where("mean is not null")


def breakdowns(
    df: DataFrame, types: dict[str, str] | None = None,
    categories: list[str] | None = None, numerics: list[str] | None = None,
) -> DataFrame:
    """Rows (category_col, numeric_col, top_value, top_mean, bottom_value, bottom_mean, pct_diff), widest gap first."""
    if categories is None or numerics is None:
        types = types or infer_types(df)
        categories = groupable(df, types, *CATEGORY) if categories is None else categories
        numerics = groupable(df, types, *NUMERIC) if numerics is None else numerics
    if not categories or not numerics:
        return df.sparkSession.createDataFrame([], EMPTY)
    by_rank = F.struct(-F.col("mean"), F.col("value"))
    compared = (
        category_means(df, categories, numerics)
        .groupBy("category_col", "numeric_col")
        .agg(
            F.count("value").alias("groups"),
            F.min_by("value", by_rank).alias("top_value"),
            F.max("mean").alias("top_mean"),
            F.max_by("value", by_rank).alias("bottom_value"),
            F.min("mean").alias("bottom_mean"),
        )
        .where("groups >= 2 and bottom_mean != 0")
    )
    pct = (F.col("top_mean") - F.col("bottom_mean")) / F.abs("bottom_mean") * 100.0
    category_place = F.create_map(*[F.lit(v) for i, c in enumerate(categories) for v in (c, i)])
    numeric_place = F.create_map(*[F.lit(v) for i, n in enumerate(numerics) for v in (n, i)])
    return (
        compared.withColumn("pct_diff", pct)
        .orderBy(
            F.abs("pct_diff").desc(),
            F.element_at(category_place, F.col("category_col")),
            F.element_at(numeric_place, F.col("numeric_col")),
        )
        .select("category_col", "numeric_col", "top_value", "top_mean", "bottom_value", "bottom_mean", "pct_diff")
    )
