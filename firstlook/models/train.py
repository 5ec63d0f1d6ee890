"""Train the fixed set of models on one table and compare them."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import as_number, data_type, nan_to_null, q
from ..operators.sample import SEED, exact_sample, row_hash
from ..operators.types import infer_types
from ..sources.order import ROW_ORDER
from .boosting import ROUNDS as BOOST_ROUNDS, Boosting
from .features import fit_features
from .forest import Forest
from .metrics import classification_metrics, comparison, headline_metric, regression_metrics, roc_auc
from .problem import BINARY, REGRESSION, ProblemInfo, detect_problem, split_features
from .split import MAX_ROWS, TEST_SHARE, SplitError, select_rows, split_rows

# The smallest training set, model sizes, messages and metric titles.
MIN_ROWS = 20
FOREST_TREES = 200
FOREST_DEPTH = 10
VALIDATION_SHARE = 0.1
LOGISTIC_ROUNDS = 1_000
# Iterative fits run many small jobs; no task gets fewer rows than this, and none more than the second number.
ROWS_PER_TASK = 5_000
MOST_ROWS_PER_TASK = 1_000_000
ERRORS = {
    "target": "Target column '{target}' not in DataFrame",
    "unknown": "Unknown feature column(s): {names}",
    "none": "No usable features (target excluded, no numeric or categorical columns left).",
    "leak": "Target column '{target}' cannot also be a feature.",
    "small": "Dataset too small to train (need ≥ {least} non-null target rows, got {rows}).",
    "split": "Failed to split data: {reason}",
}
DOWNSAMPLED = "Downsampled from {total:,} to {used:,} rows for training."
METRIC_TITLES = {"r2": "R²", "accuracy": "Accuracy", "f1_macro": "F1 (macro)"}


@dataclass
class ModelResult:
    name: str
    metrics: dict[str, float]
    train_seconds: float
    is_winner: bool = False
    error: str | None = None


@dataclass
class MLReport:
    """rows_used: the table's rows, or the bound for a classifier, of which all but the held-out share fit; rows_fitted and rows_scored say how many did."""

    target: str
    problem: ProblemInfo
    features: list[str]
    rows_used: int = 0
    rows_total: int = 0
    downsampled: bool = False
    models: list[ModelResult] = field(default_factory=list)
    note: str | None = None
    error: str | None = None
    rows_fitted: int = 0
    rows_scored: int = 0

    def results_table(self, spark: SparkSession) -> DataFrame:
        """Rows (position, model, metric, value, train_seconds, is_winner, error); an error has no metric."""
        rows = []
        for i, m in enumerate(self.models):
            for metric, value in (m.metrics or {None: None}).items():
                rows.append((i, m.name, metric, value, m.train_seconds, m.is_winner, m.error))
        return spark.createDataFrame(
            rows,
            "position int, model string, metric string, value double, train_seconds double, is_winner boolean, error string",
        )

    def winner(self) -> ModelResult | None:
        return next((m for m in self.models if m.is_winner), None)


def models_for(
    kind: str, train_rows: int, classes: int, early_stop: bool = False, forest_depth: int = FOREST_DEPTH
) -> list[tuple[str, Estimator | Boosting | Forest]]:
    """The three models of a problem kind, in a fixed order."""
    forest = {"numTrees": FOREST_TREES, "maxDepth": forest_depth, "seed": SEED}
    boosted = Boosting("squares" if kind == REGRESSION else "classes", classes, BOOST_ROUNDS, use_validation=early_stop)
    if kind == REGRESSION:
        return [
            ("LinearRegression", LinearRegression(regParam=0.0)),
            ("RandomForestRegressor", Forest(FOREST_TREES, forest_depth, SEED)),
            ("GBTRegressor", boosted),
        ]
    # An l2 penalty of one half the squared weights against the summed loss is 1/n against the mean loss.
    logistic = LogisticRegression(maxIter=LOGISTIC_ROUNDS, regParam=1.0 / train_rows, standardization=False)
    return [
        ("LogisticRegression", logistic),
        ("RandomForestClassifier", RandomForestClassifier(featureSubsetStrategy="sqrt", **forest)),
        ("GBTClassifier", boosted),
    ]


def train_models(
    df: DataFrame, target: str, features: list[str], key: str, problem: ProblemInfo | None = None,
    max_rows: int | None = MAX_ROWS, early_stop: bool = False, forest_depth: int | None = None,
) -> MLReport:
    """Split, encode, fit three models, score them on all held-out rows, pick the winner.

    All rows are split. ``max_rows`` bounds the rows that fit a classifier: no more than the training rows of a table of so many rows,
    drawn exactly from the training rows there are; None takes all. Regressions always fit on all training rows. ``early_stop`` keeps a tenth of the training rows from boosting and stops when the error on
    them no longer falls; it is off at every size unless asked for. ``forest_depth`` bounds the depth of forest trees, 10 by
    default; Spark allows up to 30, at a cost that grows with the leaves.

    ``key`` is a unique column that identifies a row; the sample and the split follow from it alone.
    Features are fitted and encoded once and cached for the three fits.
    """
    report = MLReport(target, problem or ProblemInfo("unsupported", "", None), list(features))

    def failed(which: str, **values) -> MLReport:
        report.error = ERRORS[which].format(**values)
        return report

    data = set(df.columns) - {ROW_ORDER}
    if target not in data:
        return failed("target", target=target)
    if unknown := [f for f in features if f not in data]:
        return failed("unknown", names=", ".join(unknown))
    if not features:
        return failed("none")
    if target in features:
        return failed("leak", target=target)
    if problem is None:
        report.problem = problem = detect_problem(df, target)
    if not problem.supported:
        report.error = problem.reason
        return report

    needed = list(dict.fromkeys([key, target, *features]))
    df = nan_to_null(df.select(*[q(c) for c in needed]))
    used, _, report.rows_total = select_rows(df, target, key, None)
    bound = max_rows if problem.is_classification else None
    report.rows_used = report.rows_total if bound is None else min(report.rows_total, bound)
    report.downsampled = report.rows_used < report.rows_total
    if report.rows_used < MIN_ROWS:
        return failed("small", least=MIN_ROWS, rows=report.rows_used)
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, 1 + report.rows_total // ROWS_PER_TASK), report.rows_total // MOST_ROWS_PER_TASK)
    used = used.repartition(parts, q(key)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        types = infer_types(used.select(*[q(f) for f in features]))
        numeric, categorical = split_features(types, list(features))
        if not numeric and not categorical:
            return failed("none")
        try:
            _fit_all(used, target, key, numeric, categorical, report, parts, early_stop, forest_depth or FOREST_DEPTH)
        except SplitError as reason:
            return failed("split", reason=reason)
    finally:
        used.unpersist()
    if report.downsampled:
        report.note = DOWNSAMPLED.format(total=report.rows_total, used=report.rows_used)
    return report


def _fit_all(
    used: DataFrame, target: str, key: str, numeric: list[str], categorical: list[str], report: MLReport, parts: int,
    early_stop: bool, forest_depth: int,
) -> None:
    problem = report.problem
    if problem.is_classification:
        # At most twenty classes, numbered in value order: the greater of two is the positive one.
        classes = [r[0] for r in used.select(q(target)).distinct().orderBy(q(target)).collect()]
        label = F
        for i, value in enumerate(classes):
            label = label.when(q(target) == F.lit(value), F.lit(float(i)))
    else:
        classes = []
        label = as_number(q(target), data_type(used, target))
    labelled = used.withColumn("label", label)
    split = split_rows(labelled, key, "label" if problem.is_classification else None)
    split = split.repartition(parts, q(key)).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    report.rows_fitted, report.rows_scored = train.count(), test.count()
    if report.downsampled:
        most = report.rows_used - math.ceil(TEST_SHARE * report.rows_used)
        train = exact_sample(train, most, key, rows=report.rows_fitted, ordered=False)
        report.rows_fitted = min(report.rows_fitted, most)
        # The sample is used by every fit; drawing it ends in one task.
        train = train.repartition(parts, q(key)).persist(StorageLevel.MEMORY_AND_DISK)
    fitted = fit_features(train, numeric, categorical)
    held_back = F.pmod(row_hash(key, SEED + 1), F.lit(1000)) < int(1000 * VALIDATION_SHARE)
    encoded = [
        fitted.transform(rows).select("label", "features", held_back.alias("is_validation")).persist(StorageLevel.MEMORY_AND_DISK)
        for rows in (train, test)
    ]
    try:
        for name, estimator in models_for(problem.kind, report.rows_fitted, len(classes), early_stop, forest_depth):
            report.models.append(_fit_one(name, estimator, *encoded, problem))
    finally:
        for rows in (*encoded, train, split):
            rows.unpersist()
    spark = used.sparkSession
    scored = report.results_table(spark).where("error is null")
    metric = headline_metric(problem.kind, scored)
    best = comparison(scored, metric).where("is_winner").first() if metric else None
    for m in report.models:
        m.is_winner = best is not None and m.name == best["model"]


def _fit_one(name: str, estimator: Estimator | Boosting | Forest, train: DataFrame, test: DataFrame, problem: ProblemInfo) -> ModelResult:
    """Fit and score one model; a failure becomes its error and does not stop the others."""
    start = time.perf_counter()
    try:
        model = estimator.fit(train)
        seconds = time.perf_counter() - start
        predicted = model.transform(test)
        if problem.kind == REGRESSION:
            return ModelResult(name, regression_metrics(predicted).first().asDict(), seconds)
        metrics = classification_metrics(predicted).first().asDict()
        if problem.kind == BINARY:
            scored = predicted.select("label", vector_to_array("probability")[1].alias("score"))
            metrics |= roc_auc(scored).first().asDict()
        return ModelResult(name, {k: v for k, v in metrics.items() if v is not None}, seconds)
    except Exception as reason:  # any estimator failure is this model's result
        return ModelResult(name, {}, time.perf_counter() - start, error=f"{type(reason).__name__}: {reason}")


def comparison_figure(spark: SparkSession, report: MLReport) -> dict | None:
    """Bar chart of the models by the metric that decides, best first."""
    scored = report.results_table(spark).where("error is null and metric is not null")
    metric = headline_metric(report.problem.kind, scored)
    rows = comparison(scored, metric).orderBy("rank").collect() if metric and report.models else []
    if not rows:
        return None
    title = METRIC_TITLES[metric]
    values = [r["value"] for r in rows]
    return {
        "data": [{"type": "bar", "x": [r["model"] for r in rows], "y": values, "text": [f"{v:.4f}" for v in values]}],
        "layout": {
            "title": {"text": f"{title} by model"},
            "xaxis": {"title": {"text": "Model"}},
            "yaxis": {"title": {"text": title}},
        },
    }
