"""From a target column to a kind of prediction problem."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_number, data_type, nan_to_null, q
from ..operators.types import CATEGORY, NUMERIC, infer_types

# The class limit, problem kinds and the reasons given for them.
MAX_CLASSES = 20
REGRESSION, BINARY, MULTICLASS, UNSUPPORTED = (
    "regression", "binary_classification", "multiclass_classification", "unsupported",
)
REASONS = {
    "empty": "Target column has no non-null values",
    "datetime": "Datetime targets are not supported",
    "text": "Text targets are not supported",
    "single": "Target has only {n} unique value(s); need at least 2",
    "two": "Target has exactly 2 unique values",
    "category": "Target is {kind} with {n} classes ({sign} {limit})",
    "integer": "Integer target with {n} unique values ({sign} {limit})",
    "labels": "Float target with {n} unique values that look like class labels",
    "float": "Continuous numeric target",
    "unknown": "Unrecognized target type '{kind}'",
}
USABLE = ("integer", "float", "categorical", "boolean")


@dataclass(frozen=True)
class ProblemInfo:
    kind: str
    reason: str
    n_classes: int | None = None

    @property
    def supported(self) -> bool:
        return self.kind != UNSUPPORTED

    @property
    def is_classification(self) -> bool:
        return self.kind in (BINARY, MULTICLASS)


def detect_problem(df: DataFrame, target: str, semantic_type: str | None = None) -> ProblemInfo:
    """The problem a target column poses, from its type and one aggregate over it."""
    column = nan_to_null(df.select(q(target)))
    kind = semantic_type or infer_types(column)[target]
    number = as_number(q(target), data_type(column, target))
    seen = column.agg(
        F.count_distinct(q(target)).alias("n"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.bool_and(number == F.floor(number)).alias("whole"),
    ).first()
    return classify(kind, seen["n"], seen["whole"] and (seen["low"], seen["high"]) == (0, seen["n"] - 1))


def classify(kind: str, n: int, like_labels: bool = False) -> ProblemInfo:
    """Decide from the semantic type, the distinct count and whether values are exactly 0, 1, ..., n-1."""

    def found(problem: str, reason: str) -> ProblemInfo:
        sign = "≤" if n <= MAX_CLASSES else ">"
        return ProblemInfo(problem, REASONS[reason].format(n=n, kind=kind, sign=sign, limit=MAX_CLASSES), n)

    few = n <= MAX_CLASSES
    if n == 0:
        return found(UNSUPPORTED, "empty")
    if kind in ("datetime", "text"):
        return found(UNSUPPORTED, kind)
    if n == 1:
        return found(UNSUPPORTED, "single")
    if n == 2:
        return found(BINARY, "two")
    if kind in CATEGORY:
        return found(MULTICLASS if few else UNSUPPORTED, "category")
    if kind == "integer":
        return found(MULTICLASS if few else REGRESSION, "integer")
    if kind == "float":
        return found(MULTICLASS, "labels") if few and like_labels else found(REGRESSION, "float")
    return found(UNSUPPORTED, "unknown")


def default_target(types: dict[str, str]) -> str | None:
    """The last column that is neither text nor a date, else the last column."""
    usable = [c for c, kind in types.items() if kind not in ("text", "datetime")]
    return (usable or list(types) or [None])[-1]


def candidate_features(types: dict[str, str], target: str) -> list[str]:
    return [c for c, kind in types.items() if c != target and kind in USABLE]


def split_features(types: dict[str, str], features: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) features; dates and texts are left out."""
    return (
        [c for c in features if types.get(c) in NUMERIC],
        [c for c in features if types.get(c) in CATEGORY],
    )


@dataclass(frozen=True)
class Suggestion:
    target: str
    target_type: str
    problem: ProblemInfo
    features: dict[str, str]


def suggest_model(df: DataFrame, target: str | None = None) -> Suggestion:
    """Target, problem and features to start from."""
    types = infer_types(df)
    target = target or default_target(types)
    if target is None or target not in types:
        raise ValueError("the table has no column that can be used as a target")
    return Suggestion(
        target, types[target], detect_problem(df, target, types[target]),
        {c: types[c] for c in candidate_features(types, target)},
    )
