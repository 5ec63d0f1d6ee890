"""Problem detection, splits, metrics and training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from firstlook.models.metrics import (
    best_per_metric, classification_metrics, comparison, metrics_long, regression_metrics, roc_auc,
)
from firstlook.models.problem import ProblemInfo, candidate_features, default_target, detect_problem, split_features, suggest_model
from firstlook.models.results import Results
from firstlook.models.split import select_rows, split_rows
from firstlook.models.features import fit_features
from firstlook.models.train import models_for, train_models
from firstlook.operators.types import infer_types
from firstlook.plans.written import shared_folder

from .tables import md5_place, rounded, table, union_all

# (table, target, semantic type, problem kind, reason) with {n} for the distinct count.
TARGETS = [
    ("labels", "quality", "binary_classification", "Target has exactly 2 unique values"),
    ("lineitem", "l_linenumber", "multiclass_classification", "Integer target with {n} unique values (≤ 20)"),
    ("lineitem", "l_extendedprice", "regression", "Continuous numeric target"),
    ("lineitem", "l_discount", "regression", "Continuous numeric target"),
    ("lineitem", "l_returnflag", "multiclass_classification", "Target is categorical with {n} classes (≤ 20)"),
    ("lineitem", "l_linestatus", "binary_classification", "Target has exactly 2 unique values"),
    ("part", "p_size", "regression", "Integer target with {n} unique values (> 20)"),
    ("part", "p_brand", "unsupported", "Target is categorical with {n} classes (> 20)"),
    ("customer", "c_name", "unsupported", "Text targets are not supported"),
    ("orders", "o_orderdate", "unsupported", "Datetime targets are not supported"),
]


def problem_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, target, *_ in TARGETS:
        found = detect_problem(table(spark, sf_dir, name), target)
        rows.append((name, target, found.kind, found.reason, found.n_classes))
    return spark.createDataFrame(rows, "table string, target string, kind string, reason string, n_classes long")


def target_and_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    types = infer_types(customer)
    target = default_target(types)
    numeric, categorical = split_features(types, candidate_features(types, target))
    found = suggest_model(customer)
    rows = [(found.target, found.problem.kind, f, "numeric") for f in numeric]
    rows += [(found.target, found.problem.kind, f, "categorical") for f in categorical]
    return spark.createDataFrame(rows, "target string, kind string, feature string, feature_kind string")


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.xxhash64(F.struct("*")).alias("line_key"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("target"),
    )
    chosen, used, total = select_rows(lines, "target", "line_key", max_rows=20_000)
    return chosen.agg(
        F.count("target").alias("rows"), F.lit(used).cast("long").alias("rows_used"), F.lit(total).cast("long").alias("rows_total")
    )


def training_rows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, used, total = select_rows(table(spark, sf_dir, "lineitem"), "l_quantity", "l_orderkey", max_rows=None)
    return chosen.agg(
        F.count("l_quantity").alias("rows"), F.lit(used).cast("long").alias("rows_used"), F.lit(total).cast("long").alias("rows_total")
    )


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_rows(table(spark, sf_dir, "labels"), "doc_id", "quality")
    return split.groupBy("quality", "is_test").agg(F.count("doc_id").alias("rows"))


def split_sizes_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_rows(table(spark, sf_dir, "orders"), "o_orderkey")
    return split.groupBy("is_test").agg(F.count("o_orderkey").alias("rows"))


def _training(spark: SparkSession, report) -> DataFrame:
    if report.error:
        raise RuntimeError(report.error)
    if errors := [f"{m.name}: {m.error}" for m in report.models if m.error]:
        raise RuntimeError("; ".join(errors))
    return rounded(report.results_table(spark).drop("train_seconds"))


GUARDS = {
    "unknown target": ("no_such", ["o_custkey"]), "unknown feature": ("o_totalprice", ["o_custkey", "nope"]),
    "no feature": ("o_totalprice", []), "leak": ("o_totalprice", ["o_totalprice"]), "few rows": ("rare", ["o_custkey"]),
}


def train_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What training says about requests it cannot serve; the last one has a target in three rows only."""
    orders = table(spark, sf_dir, "orders").withColumn("rare", F.when(F.col("o_orderkey") <= 3, F.col("o_totalprice")))
    problem = ProblemInfo("regression", "", None)
    rows = [(name, train_models(orders, target, features, "o_orderkey", problem).error) for name, (target, features) in GUARDS.items()]
    return spark.createDataFrame(rows, "request string, error string")


def train_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of a straight line from quantity to price, fitted on the training rows of a split and scored on the others."""
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("x"), F.col("o_totalprice").alias("label"))
    split = split_rows(lines, "o_orderkey")
    ready = fit_features(split.where(~F.col("is_test")), ["x"], []).transform(split)
    _, estimator = models_for("regression", 0, 0)[0]
    model = estimator.fit(ready.where(~F.col("is_test")))
    return rounded(regression_metrics(model.transform(ready.where("is_test"))).select("mae", "rmse"), 3)


def train_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return _training(spark, train_models(orders, "o_totalprice", ["o_custkey", "o_orderstatus", "o_orderpriority"], "o_orderkey", max_rows=None))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id")


def train_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _training(spark, train_models(_labelled(spark, sf_dir), "quality", ["lang", "source", "n_chars"], "doc_id"))


def train_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return _training(spark, train_models(customer, "c_mktsegment", ["c_nationkey", "c_acctbal"], "c_custkey"))


def _predictors(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three simple rules that guess the price of a line."""
    lines = table(spark, sf_dir, "lineitem")
    rules = {
        "flat": F.lit(53000.0), "by_quantity": F.col("l_quantity") * 2100.0, "by_line": F.col("l_linenumber") * 13000.0,
    }
    return {name: lines.select(F.col("l_extendedprice").alias("label"), rule.alias("prediction")) for name, rule in rules.items()}


def _rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = None
    for i, (name, predictions) in enumerate(_predictors(spark, sf_dir).items()):
        long = metrics_long(regression_metrics(predictions)).select(
            F.lit(i).alias("position"), F.lit(name).alias("model"), "metric", "value"
        )
        results = long if results is None else results.unionByName(long)
    return results


def metrics_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regression_metrics(_predictors(spark, sf_dir)["by_quantity"]))


def metrics_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    guess = F.when(F.col("l_linenumber") <= 2, "A").when(F.col("l_quantity") > 25, "N").when(F.col("l_tax") > 0.01, "R").otherwise("X")
    return rounded(classification_metrics(lines.select(F.col("l_returnflag").alias("label"), guess.alias("prediction"))))


def metrics_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)
    return rounded(roc_auc(lines.select(label.alias("label"), (F.col("l_extendedprice") * F.col("l_discount")).alias("score"))))


def winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparison(_rule_results(spark, sf_dir), "r2"))


def best_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(best_per_metric(_rule_results(spark, sf_dir)))


def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    kept = Results(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    kept.put("lines", "l_extendedprice", _rule_results(spark, sf_dir))
    return rounded(kept.get("lines", "l_extendedprice").drop("position"))


RULES = {"flat": "53000.0", "by_quantity": "l_quantity * 2100.0", "by_line": "l_linenumber * 13000.0"}


def _rule_sql() -> str:
    """Rows (position, model, r2, mae, rmse) of the three rules."""
    return union_all([
        f"""SELECT {i} AS position, '{name}' AS model, 1 - sum(e * e) / (var_pop(y) * count(y)) AS r2, avg(abs(e)) AS mae, sqrt(sum(e * e) / count(y)) AS rmse
        FROM (SELECT l_extendedprice AS y, l_extendedprice - CAST({rule} AS DOUBLE) AS e FROM lineitem)""" for i, (name, rule) in enumerate(RULES.items())
    ])


def _split_sql(name: str, label: str) -> str:
    """Test rows per class by largest remainder over the training rows."""
    return f"""
    WITH sizes AS (SELECT {label} AS class, count(*) AS n FROM {name} GROUP BY 1),
    shares AS (SELECT class, n, n * (t.total - CAST(ceil(0.2 * t.total) AS BIGINT)) / t.total AS share, t.total - CAST(ceil(0.2 * t.total) AS BIGINT) AS n_train
        FROM sizes, (SELECT CAST(sum(n) AS BIGINT) AS total FROM sizes) t),
    ranked AS (SELECT *, row_number() OVER (ORDER BY floor(share) - share, CAST(class AS VARCHAR)) AS place, sum(floor(share)) OVER () AS given FROM shares),
    train AS (SELECT class, n, CAST(floor(share) + CASE WHEN place <= n_train - given THEN 1 ELSE 0 END AS BIGINT) AS rows FROM ranked)
    SELECT class AS {label}, false AS is_test, rows FROM train UNION ALL SELECT class, true, n - rows FROM train"""


QUERIES = {
    "problem_types": (problem_types, union_all([
        f"""SELECT '{name}' AS "table", '{target}' AS target, '{kind}' AS kind,
            replace('{reason}', '{{n}}', CAST(count(DISTINCT {target}) AS VARCHAR)) AS reason, count(DISTINCT {target}) AS n_classes FROM {name}"""
        for name, target, kind, reason in TARGETS
    ])),
    "target_and_features": (target_and_features, """
        SELECT 'c_mktsegment' AS target, CASE WHEN count(DISTINCT c_mktsegment) = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END AS kind,
            unnest(['c_custkey', 'c_nationkey', 'c_acctbal']) AS feature, 'numeric' AS feature_kind FROM customer"""),
    "training_rows": (training_rows, """
        SELECT least(count(*), 20000) AS rows, least(count(*), 20000) AS rows_used, count(*) AS rows_total FROM lineitem WHERE l_returnflag <> 'N'"""),
    "training_rows_all": (training_rows_all, "SELECT count(*) AS rows, count(*) AS rows_used, count(*) AS rows_total FROM lineitem"),
    "train_guards": (train_guards, """
        SELECT 'unknown target' AS request, 'Target column ''no_such'' not in DataFrame' AS error
        UNION ALL SELECT 'unknown feature', 'Unknown feature column(s): nope'
        UNION ALL SELECT 'no feature', 'No usable features (target excluded, no numeric or categorical columns left).'
        UNION ALL SELECT 'leak', 'Target column ''o_totalprice'' cannot also be a feature.'
        UNION ALL SELECT 'few rows', 'Dataset too small to train (need ≥ 20 non-null target rows, got ' || count(*) || ').' FROM orders WHERE o_orderkey <= 3"""),
    "train_linear": (train_linear, f"""
        WITH placed AS (SELECT o_custkey AS x, o_totalprice AS y, row_number() OVER (ORDER BY {md5_place('o_orderkey')}, o_orderkey) AS place,
            ceil(0.2 * count(*) OVER ()) AS n FROM orders),
        line AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS start FROM placed WHERE place > n)
        SELECT round(avg(abs(y - start - slope * x)), 3) AS mae, round(sqrt(avg((y - start - slope * x) ** 2)), 3) AS rmse
        FROM placed, line WHERE place <= n"""),
    "split_sizes": (split_sizes, _split_sql("labels", "quality")),
    "split_sizes_plain": (split_sizes_plain, """
        SELECT true AS is_test, CAST(ceil(0.2 * count(*)) AS BIGINT) AS rows FROM orders
        UNION ALL SELECT false, count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) FROM orders"""),
    "metrics_regression": (metrics_regression, f"SELECT round(r2, 6) AS r2, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM ({_rule_sql()}) WHERE model = 'by_quantity'"),
    "metrics_classification": (metrics_classification, """
        WITH p AS (SELECT l_returnflag AS label, CASE WHEN l_linenumber <= 2 THEN 'A' WHEN l_quantity > 25 THEN 'N' WHEN l_tax > 0.01 THEN 'R' ELSE 'X' END AS prediction FROM lineitem),
        classes AS (SELECT label AS class FROM p UNION SELECT prediction FROM p),
        f1 AS (SELECT class, 2.0 * (SELECT count(*) FROM p WHERE label = class AND prediction = class)
            / ((SELECT count(*) FROM p WHERE label = class) + (SELECT count(*) FROM p WHERE prediction = class)) AS f FROM classes)
        SELECT round((SELECT count(*) FILTER (label = prediction) / count(*) FROM p), 6) AS accuracy, round(avg(f), 6) AS f1_macro FROM f1"""),
    "metrics_auc": (metrics_auc, """
        WITH p AS (SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label, l_extendedprice * l_discount AS score FROM lineitem),
        r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS place FROM p)
        SELECT round((sum(place) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
            / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)), 6) AS roc_auc FROM r"""),
    "winner": (winner, f"""SELECT CAST(row_number() OVER (ORDER BY r2 DESC, position) AS INTEGER) AS rank, model, round(r2, 6) AS value,
        row_number() OVER (ORDER BY r2 DESC, position) = 1 AS is_winner FROM ({_rule_sql()})"""),
    "best_per_metric": (best_metrics, f"""WITH r AS ({_rule_sql()}) SELECT 'r2' AS metric, round(max(r2), 6) AS best FROM r
        UNION ALL SELECT 'mae', round(min(mae), 6) FROM r UNION ALL SELECT 'rmse', round(min(rmse), 6) FROM r"""),
    "results_roundtrip": (results_roundtrip, f"""WITH r AS ({_rule_sql()}), long AS (SELECT model, 'r2' AS metric, r2 AS value FROM r
        UNION ALL SELECT model, 'mae', mae FROM r UNION ALL SELECT model, 'rmse', rmse FROM r)
        SELECT 'lines' AS dataset_id, 'l_extendedprice' AS target, model, metric, round(value, 6) AS value FROM long"""),
    "train_regression": (train_regression, None),
    "train_binary": (train_binary, None),
    "train_multiclass": (train_multiclass, None),
}
