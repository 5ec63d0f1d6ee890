"""All findings about a table in one report."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import nan_to_null, q
from ..plans.reuse import reused
from .breakdowns import breakdowns
from .clean import data_columns
from .correlations import MIN_ABS_R, correlations
from .sentences import MAX_SENTENCES, sentences
from .stats import stats_report
from .trends import trends
from .types import NUMERIC, groupable, profile


@dataclass
class InsightsReport:
    schema: dict = field(default_factory=dict)
    columns: dict = field(default_factory=dict)
    correlations: list = field(default_factory=list)
    trends: list = field(default_factory=list)
    category_breakdowns: list = field(default_factory=list)
    insight_sentences: list = field(default_factory=list)

    def to_dict(self) -> dict:
        return {name: getattr(self, name) for name in self.__dataclass_fields__}


def trend_records(table: DataFrame) -> list[dict]:
    rounding = {"first_value": 4, "last_value": 4, "pct_change": 2}
    records = [_rounded(r.asDict(), rounding) for r in table.collect()]
    return sorted(records, key=lambda r: -abs(r["pct_change"]))


def correlation_records(table: DataFrame) -> list[dict]:
    return sorted((_rounded(r.asDict(), {"r": 4}) for r in table.collect()), key=lambda r: -abs(r["r"]))


def breakdown_records(table: DataFrame) -> list[dict]:
    records = [
        {
            "category_col": r["category_col"],
            "numeric_col": r["numeric_col"],
            "top": {"value": r["top_value"], "mean": round(r["top_mean"], 4)},
            "bottom": {"value": r["bottom_value"], "mean": round(r["bottom_mean"], 4)},
            "pct_diff": round(r["pct_diff"], 2),
        }
        for r in table.collect()
    ]
    return sorted(records, key=lambda r: -abs(r["pct_diff"]))


def _rounded(record: dict, digits: dict[str, int]) -> dict:
    return {k: round(v, digits[k]) if k in digits else v for k, v in record.items()}


def insights(df: DataFrame, min_abs_corr: float = MIN_ABS_R, types: dict[str, str] | None = None) -> InsightsReport:
    """Types, statistics, correlations, trends, category gaps and sentences of one (cleaned) table.

    Every section is a handful of aggregates that read only their own columns; the report holds one
    entry per column or pair of columns.
    """
    with reused(nan_to_null(df.select(*[q(c) for c in data_columns(df)]))) as table:
        return _report(table, min_abs_corr, types)


def _report(df: DataFrame, min_abs_corr: float, types: dict[str, str] | None) -> InsightsReport:
    known = profile(df)
    types = types or known.types
    columns = stats_report(df, types)
    pairs = correlation_records(correlations(df, groupable(df, types, *NUMERIC), min_abs_corr))
    changes = trend_records(trends(df, types))
    gaps = breakdown_records(breakdowns(df, types))
    return InsightsReport(
        schema={"rows": known.rows, "cols": len(types), "by_type": dict(Counter(types.values()))},
        columns=columns,
        correlations=pairs,
        trends=changes,
        category_breakdowns=gaps,
        insight_sentences=sentences(
            changes[:MAX_SENTENCES], pairs[:MAX_SENTENCES], gaps[:MAX_SENTENCES], columns
        ),
    )


def report_table(spark: SparkSession, report: dict) -> DataFrame:
    """A report as rows (section, content as JSON), ready for ``write.json``."""
    rows = [(name, json.dumps(value)) for name, value in report.items()]
    return spark.createDataFrame(rows, "section string, content string")
