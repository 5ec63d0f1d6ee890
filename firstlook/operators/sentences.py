"""Findings as ranked sentences.

Findings are a few report rows by the time they get here (at most ten of each kind, and one row of
statistics per column), so they are worded on the driver, where rounding is exact.
"""

from __future__ import annotations

from itertools import islice
from typing import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Limits and the wording of the sentences.
MAX_SENTENCES = 10
STRONG_R = 0.7
HIGH_SKEW = 1.0
OUTLIER_SHARE = 0.05
TREND = "{column} {verb} {pct:.1f}% from {first_period} to {last_period}."
CORRELATION = "{a} and {b} are {strength} {sign} correlated (r={r:.2f})."
CATEGORY = "{category_col} '{top}' has {pct:.1f}% {word} average {numeric_col} than '{bottom}'."
SKEWED = "{side}-skewed (skew={skew:.2f})"
OUTLYING = "{outliers} IQR-outlier values ({share:.0%})"


def trend_sentence(trend: dict) -> str:
    verb = "increased" if trend["direction"] == "up" else "decreased"
    return TREND.format(verb=verb, pct=abs(trend["pct_change"]), **trend)


def correlation_sentence(pair: dict) -> str:
    strength = "strongly" if abs(pair["r"]) >= STRONG_R else "moderately"
    sign = "positively" if pair["r"] >= 0 else "negatively"
    return CORRELATION.format(strength=strength, sign=sign, **pair)


def category_sentence(gap: dict) -> str:
    word = "higher" if gap["pct_diff"] >= 0 else "lower"
    return CATEGORY.format(
        category_col=gap["category_col"], numeric_col=gap["numeric_col"], word=word,
        top=gap["top"]["value"], bottom=gap["bottom"]["value"], pct=abs(gap["pct_diff"]),
    )


def distribution_sentence(column: str, stats: dict) -> str | None:
    """Sentence on a strong skew or many outliers; None for an unremarkable column."""
    skew, rows = stats.get("skew"), stats.get("count") or 0
    share = (stats.get("outliers_iqr") or 0) / rows if rows else 0
    flags = []
    if skew is not None and abs(skew) > HIGH_SKEW:
        flags.append(SKEWED.format(side="right" if skew > 0 else "left", skew=skew))
    if share > OUTLIER_SHARE:
        flags.append(OUTLYING.format(outliers=stats["outliers_iqr"], share=share))
    return f"{column} is {'; '.join(flags)}." if flags else None


def sentences(
    trends: Iterable[dict], correlations: Iterable[dict], breakdowns: Iterable[dict], columns: dict[str, dict]
) -> list[str]:
    """The ten most newsworthy: trends, then correlations, then categories, then distributions."""

    def all_sentences() -> Iterator[str]:
        yield from map(trend_sentence, trends)
        yield from map(correlation_sentence, correlations)
        yield from map(category_sentence, breakdowns)
        for name, column in columns.items():
            if column["type"] in ("integer", "float"):
                if sentence := distribution_sentence(name, column["stats"]):
                    yield sentence

    return list(islice(all_sentences(), MAX_SENTENCES))


def sentences_table(spark: SparkSession, found: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(found, 1)), "rank int, sentence string")
