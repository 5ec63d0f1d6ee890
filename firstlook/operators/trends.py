"""Change of every numeric column from the first to the last quarter of the time axis."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_number, data_type, q
from ..functions.dates import as_datetime, elapsed_days, micros_between, period_label
from .types import NUMERIC, groupable, infer_types

# Fixed values of the trend rules.
PERIODS = 4
QUARTER_FROM_DAYS = 365
MONTH_FROM_DAYS = 90
EMPTY = (
    "column string, period_col string, first_period string, last_period string, "
    "first_value double, last_value double, pct_change double, direction string"
)


@dataclass(frozen=True)
class TimeAxis:
    column: str
    start: datetime
    end: datetime
    span_days: int

    @property
    def kind(self) -> str:
        if self.span_days >= QUARTER_FROM_DAYS:
            return "quarter"
        return "month" if self.span_days >= MONTH_FROM_DAYS else "week"


def time_spans(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per date column with any date: (position, column, start, end, span_days)."""
    dates = df.select(*[as_datetime(q(n), data_type(df, n)).alias(n) for n in names])
    ends = dates.agg(*[agg(q(n)).alias(f"{label}{i}") for i, n in enumerate(names)
                       for label, agg in (("a", F.min), ("z", F.max))])
    return ends.select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(n).alias("column"),
            F.col(f"a{i}").alias("start"),
            F.col(f"z{i}").alias("end"),
            elapsed_days(F.col(f"a{i}"), F.col(f"z{i}")).alias("span_days"),
        )
        for i, n in enumerate(names)
    ]))).where("start is not null")


def widest_datetime(df: DataFrame, names: list[str]) -> TimeAxis | None:
    """The date column that spans the most whole days; the first column wins a tie."""
    if not names:
        return None
    best = time_spans(df, names).orderBy(F.col("span_days").desc(), "position").first()
    return TimeAxis(best["column"], best["start"], best["end"], best["span_days"]) if best else None


def _edge(axis: TimeAxis, which: str) -> Column:
    return F.lit(getattr(axis, which).isoformat(sep=" ")).cast("timestamp_ntz")


def period_of(col: Column, axis: TimeAxis) -> Column:
    """Period 1 to 4 of equal width, closed on the right; the very first instant is in period 1.

    Whole microseconds, so a value on an edge never depends on floating point.
    """
    span = micros_between(_edge(axis, "start"), _edge(axis, "end"))
    offset = micros_between(_edge(axis, "start"), col)
    nth = F.call_function("div", offset * PERIODS + span - 1, span)
    return F.when(offset.isNotNull(), F.greatest(F.lit(1), nth.cast("int")))


def left_edge(period: Column, axis: TimeAxis) -> Column:
    span = micros_between(_edge(axis, "start"), _edge(axis, "end"))
    offset = F.call_function("div", (period - 1) * span, F.lit(PERIODS).cast("long"))
    return F.timestamp_add("MICROSECOND", offset, _edge(axis, "start"))


def trends(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """One row per numeric column that can be compared over time, largest change first.

    The time axis costs one small aggregate; the sums of all columns in all periods are one more,
    with four groups that fill up map-side.
    """
    types = types or infer_types(df)
    axis = widest_datetime(df, groupable(df, types, "datetime"))
    names = [c for c in groupable(df, types, *NUMERIC) if axis and c != axis.column]
    if axis is None or axis.span_days <= 0 or not names:
        return df.sparkSession.createDataFrame([], EMPTY)

    moment = as_datetime(q(axis.column), data_type(df, axis.column))
    placed = df.select(
        period_of(moment, axis).alias("_period"),
        *[as_number(q(n), data_type(df, n)).alias(n) for n in names],
    ).where("_period is not null")
    sums = placed.groupBy("_period").agg(
        *[F.sum(q(n)).alias(f"s{i}") for i, n in enumerate(names)],
    )
    long = sums.select("_period", F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.col(f"s{i}").alias("total"))
        for i, n in enumerate(names)
    ]))).where("total is not null")
    ends = long.groupBy("position", "column").agg(
        F.min("_period").alias("first"),
        F.max("_period").alias("last"),
        F.min_by("total", "_period").alias("first_value"),
        F.max_by("total", "_period").alias("last_value"),
        F.count_if(F.col("total") != 0).alias("filled"),
    ).where("filled >= 2 and first_value != 0")
    change = (F.col("last_value") - F.col("first_value")) / F.abs("first_value") * 100.0
    return (
        ends.withColumn("pct_change", change)
        .orderBy(F.abs("pct_change").desc(), "position")
        .select(
            "column",
            F.lit(axis.column).alias("period_col"),
            period_label(left_edge(F.col("first"), axis), axis.kind).alias("first_period"),
            period_label(left_edge(F.col("last"), axis), axis.kind).alias("last_period"),
            "first_value",
            "last_value",
            "pct_change",
            F.when(F.col("pct_change") >= 0, "up").otherwise("down").alias("direction"),
        )
    )
