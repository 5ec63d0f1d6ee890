"""Value counts of many columns in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_label, data_type, q


def labels_long(df: DataFrame, names: list[str], keep: list[str] = ()) -> DataFrame:
    """One row per cell of the named columns: (``keep``..., column, value), without missing values."""
    labels = [as_label(q(n), data_type(df, n)).alias(n) for n in names]
    wide = df.select(*[q(k) for k in keep], *labels)
    return wide.unpivot([q(k) for k in keep], [q(n) for n in names], "column", "value").where("value is not null")


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows (column, value, count); equal values meet map-side, so a frequent one costs nothing extra."""
    return labels_long(df, names).groupBy("column", "value").count()


def top_values(df: DataFrame, names: list[str]) -> DataFrame:
    """Per column: non-null rows, distinct values, the most frequent value (smallest on ties) and its count."""
    return (
        value_counts(df, names)
        .groupBy("column")
        .agg(
            F.sum("count").alias("rows"),
            F.count("value").alias("unique"),
            F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("top"),
            F.max("count").alias("top_count"),
        )
    )
