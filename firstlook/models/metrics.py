"""Quality of predictions, as aggregates over (label, prediction, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.ordered import running_total

LOWER_IS_BETTER = ("mae", "rmse")


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """One row (r2, mae, rmse) from columns label and prediction."""
    error = F.col("label") - F.col("prediction")
    sums = predictions.agg(
        F.sum(error * error).alias("squares"),
        F.avg(F.abs(error)).alias("mae"),
        F.count("label").alias("n"),
        F.var_pop("label").alias("variance"),
    )
    spread = F.col("variance") * F.col("n")
    r2 = F.when(spread != 0, F.lit(1.0) - F.try_divide(F.col("squares"), spread)).otherwise(
        F.when(F.col("squares") == 0, 1.0).otherwise(0.0)
    )
    return sums.select(r2.alias("r2"), "mae", F.sqrt(F.col("squares") / F.col("n")).alias("rmse"))


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """One row (accuracy, f1_macro): the mean F1 over every class that was seen or predicted."""
    confusion = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    roles = confusion.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )))
    classes = roles.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")])
    f1 = 2.0 * F.col("hits") / (F.col("actual") + F.col("predicted"))
    return classes.agg((F.sum("hits") / F.sum("actual")).alias("accuracy"), F.avg(f1).alias("f1_macro"))


def roc_auc(predictions: DataFrame) -> DataFrame:
    """One row (roc_auc): the share of (positive, negative) pairs that the score puts in order.

    Rows collapse to one per distinct score first; the negatives below each score are a running total
    over score ranges, so no task sorts all predictions. Labels are 0 and 1; one class only gives NULL.
    """
    positive = F.col("label").cast("int")
    by_score = predictions.groupBy("score").agg(
        F.sum(positive).alias("positives"), F.sum(1 - positive).alias("negatives")
    )
    placed = running_total(by_score, "score", "negatives")
    won = F.col("positives") * (F.col("before") + F.col("negatives") / 2.0)
    pairs = F.sum("positives").cast("double") * F.sum("negatives")
    return placed.agg(F.try_divide(F.sum(won), pairs).alias("roc_auc"))


def metrics_long(metrics: DataFrame) -> DataFrame:
    """Metric columns as rows (metric, value)."""
    return metrics.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in metrics.columns
    ])))


def best_per_metric(results: DataFrame) -> DataFrame:
    """Rows (metric, best) from rows (model, metric, value); errors are best when small."""
    best = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("low")).otherwise(F.col("high"))
    ends = results.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.select("metric", best.alias("best"))


def headline_metric(problem_kind: str, results: DataFrame) -> str | None:
    """The metric that decides: r2 for regression, else accuracy, else macro F1."""
    if problem_kind == "regression":
        return "r2"
    present = {r["metric"] for r in results.select("metric").distinct().collect()}
    return next((m for m in ("accuracy", "f1_macro") if m in present), None)


def comparison(results: DataFrame, metric: str) -> DataFrame:
    """Models by one metric, best first: (rank, model, value, is_winner). Equal values keep their order.

    ``results`` has one row per model and metric, (position, model, metric, value), so it is small.
    """
    ranked = results.where(F.col("metric") == metric).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("key"), "position", "model", "value"))).alias("models")
    )
    return ranked.select(F.posexplode("models").alias("at", "m")).select(
        (F.col("at") + 1).alias("rank"),
        F.col("m.model").alias("model"),
        F.col("m.value").alias("value"),
        (F.col("at") == 0).alias("is_winner"),
    )
