"""Problem kinds, splits, features, metrics, training and results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firstlook.models.features import fit_features
from firstlook.models.metrics import best_per_metric, classification_metrics, comparison, regression_metrics, roc_auc
from firstlook.models.problem import candidate_features, classify, default_target, detect_problem, split_features, suggest_model
from firstlook.models.results import Results
from firstlook.models.split import SplitError, select_rows, split_rows, test_quotas as quotas
from firstlook.models.train import comparison_figure, train_models


@pytest.mark.parametrize("kind, n, like_labels, problem, words", [
    ("integer", 0, False, "unsupported", "no non-null"), ("datetime", 9, False, "unsupported", "Datetime"),
    ("text", 9, False, "unsupported", "Text"), ("integer", 1, False, "unsupported", "only 1 unique"),
    ("float", 2, False, "binary_classification", "exactly 2"), ("boolean", 4, False, "multiclass_classification", "boolean with 4 classes"),
    ("categorical", 20, False, "multiclass_classification", "≤ 20"), ("categorical", 21, False, "unsupported", "> 20"),
    ("integer", 20, False, "multiclass_classification", "Integer target"), ("integer", 21, False, "regression", "> 20"),
    ("float", 3, True, "multiclass_classification", "class labels"), ("float", 3, False, "regression", "Continuous"),
    ("float", 21, True, "regression", "Continuous"), ("odd", 5, False, "unsupported", "odd"),
])
def test_problem_rules(kind, n, like_labels, problem, words):
    found = classify(kind, n, like_labels)
    assert found.kind == problem and words in found.reason and found.n_classes == n


def test_detect_problem(spark):
    df = spark.createDataFrame([(float(i % 3), i % 2 == 0, f"t{i}", i * 0.5) for i in range(60)], "f double, b boolean, t string, r double")
    assert detect_problem(df, "f", "float").reason.endswith("look like class labels")
    assert detect_problem(df.withColumn("f", F.col("f") + 1), "f", "float").kind == "regression"
    assert detect_problem(df, "b").kind == "binary_classification"
    assert detect_problem(df, "t").kind == "unsupported" and detect_problem(df, "r").kind == "regression"


def test_targets_and_features(spark):
    types = {"id": "integer", "city": "categorical", "note": "text", "day": "datetime"}
    assert default_target(types) == "city" and default_target({"n": "text", "d": "datetime"}) == "d" and default_target({}) is None
    assert candidate_features(types, "city") == ["id"]
    assert split_features(types, ["city", "note", "id"]) == (["id"], ["city"])
    found = suggest_model(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)], "n int, c string"))
    assert (found.target, found.problem.kind, found.features) == ("c", "binary_classification", {"n": "integer"})


def test_quotas_add_up():
    assert quotas({"a": 50, "b": 30, "c": 21}) == {"a": 11, "b": 6, "c": 4}
    for sizes in ({"a": 7, "b": 3}, {0: 998, 1: 2}, {k: 13 for k in range(7)}):
        got = quotas(sizes)
        assert sum(got.values()) == int(np.ceil(0.2 * sum(sizes.values()))) and all(0 <= got[c] <= sizes[c] for c in sizes)
    with pytest.raises(SplitError, match="1 member"):
        quotas({"a": 9, "b": 1})
    with pytest.raises(SplitError, match="test size"):
        quotas({k: 2 for k in range(9)})


def test_split_is_exact_stratified_and_stable(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise("rare").alias("c"), F.rand(1).alias("x")).repartition(5)
    split = split_rows(df, "id", "c")
    sizes = {(r[0], r[1]): r[2] for r in split.groupBy("c", "is_test").count().collect()}
    assert sizes["hot", True] + sizes["rare", True] == 201 and sizes["rare", True] == 20
    chosen = sorted(r[0] for r in split.where("is_test").select("id").collect())
    assert chosen == sorted(r[0] for r in split_rows(df.repartition(2), "id", "c").where("is_test").select("id").collect())
    assert split_rows(df, "id").where("is_test").count() == 201


def test_rows_are_sampled_exactly(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("y"))
    chosen, used, total = select_rows(df, "y", "id", 500)
    assert (chosen.count(), used, total) == (500, 500, 2000)
    assert select_rows(df, "y", "id")[1:] == (2000, 2000)


def test_features(spark):
    train = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (None, "x"), (9.0, None)], "n double, c string")
    fitted = fit_features(train, ["n"], ["c"])
    rows = fitted.transform(spark.createDataFrame([(None, "x"), (3.0, "z"), (1.0, None), (1.0, "y")], "n double, c string")).collect()
    filled = np.array([1, 3, 3, 9.0])
    assert rows[0]["features"].toArray() == pytest.approx([(3 - filled.mean()) / filled.std(), 1, 0])
    assert rows[1]["features"].toArray()[1:] == pytest.approx([0, 0])
    assert rows[2]["features"].toArray()[1:] == pytest.approx([1, 0]) and rows[3]["features"].toArray()[1:] == pytest.approx([0, 1])
    constant = fit_features(train.withColumn("n", F.lit(4.0)), ["n"], [])
    assert constant.transform(train.withColumn("n", F.lit(5.0))).first()["features"].toArray() == pytest.approx([1.0])


def test_regression_metrics(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(size=200), rng.normal(size=200)
    row = regression_metrics(spark.createDataFrame(pd.DataFrame({"label": y, "prediction": p}))).first()
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["mae"] == pytest.approx(abs(y - p).mean()) and row["rmse"] == pytest.approx(((y - p) ** 2).mean() ** 0.5)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert regression_metrics(flat).first()["r2"] == 1.0
    assert regression_metrics(flat.withColumn("prediction", F.lit(2.0))).first()["r2"] == 0.0


def test_classification_metrics(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("c", "d")]
    row = classification_metrics(spark.createDataFrame(rows, "label string, prediction string")).first()
    assert row["accuracy"] == pytest.approx(0.4) and row["f1_macro"] == pytest.approx((2 / 3 + 0.5 + 0 + 0) / 4)


@pytest.mark.parametrize("levels", [3, 1000])
def test_auc_counts_pairs(spark, levels):
    rng = np.random.default_rng(levels)
    y, s = rng.integers(0, 2, 400), rng.integers(0, levels, 400).astype(float)
    won = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    df = spark.createDataFrame(pd.DataFrame({"label": y.astype(float), "score": s}))
    assert roc_auc(df).first()[0] == pytest.approx(won)
    assert roc_auc(df.where("label = 1")).first()[0] is None


RESULTS = [(0, "A", "r2", 0.5), (1, "B", "r2", 0.7), (2, "C", "r2", 0.7), (0, "A", "mae", 1.0), (1, "B", "mae", 3.0)]


def test_comparison_and_best(spark):
    results = spark.createDataFrame(RESULTS, "position int, model string, metric string, value double")
    assert [tuple(r) for r in comparison(results, "r2").orderBy("rank").collect()] == [(1, "B", 0.7, True), (2, "C", 0.7, False), (3, "A", 0.5, False)]
    assert {r["metric"]: r["best"] for r in best_per_metric(results).collect()} == {"r2": 0.7, "mae": 1.0}


def test_results_store(spark, tmp_path):
    kept = Results(spark, str(tmp_path / "results"))
    table = spark.createDataFrame(RESULTS, "position int, model string, metric string, value double")
    for dataset, target in (("d1", "y"), ("d1", "a/b %"), ("d2", "y")):
        kept.put(dataset, target, table)
    kept.put("d1", "y", table.limit(1))
    assert kept.get("d1", "y").count() == 1 and kept.get("d1", "a/b %").first()["target"] == "a/b %" and kept.get("d3", "y") is None
    kept.clear(target="y")
    assert kept.get("d1", "y") is None and kept.get("d2", "y") is None and kept.get("d1", "a/b %") is not None
    kept.clear("d1")
    assert kept.get("d1", "a/b %") is None
    kept.put("d9", "y", table)
    kept.clear()
    assert kept.get("d9", "y") is None


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(11)
    n = 240
    frame = pd.DataFrame({"id": np.arange(n), "f1": rng.normal(size=n), "f2": rng.normal(size=n), "c": rng.choice(["u", "v"], n)})
    frame["y"] = 3 * frame.f1 - 2 * frame.f2 + (frame.c == "u") + rng.normal(size=n) * 0.1
    frame["yes"] = (frame.f1 + frame.f2 > 0).astype(int)
    frame["three"] = np.digitize(frame.f1, [-0.4, 0.4])
    frame["word"] = [f"w{i}" for i in range(n)]
    return spark.createDataFrame(frame).cache()


@pytest.fixture(autouse=True)
def small_models(monkeypatch):
    from firstlook.models import boosting, train

    monkeypatch.setattr(train, "FOREST_TREES", 20)
    monkeypatch.setattr(train, "FOREST_DEPTH", 5)
    monkeypatch.setattr(train, "BOOST_ROUNDS", 10)
    monkeypatch.setattr(boosting, "LEAST_ROWS", 2)


def test_train_regression(spark, samples):
    report = train_models(samples, "y", ["f1", "f2", "c"], "id")
    assert report.error is None and [m.name for m in report.models] == ["LinearRegression", "RandomForestRegressor", "GBTRegressor"]
    assert report.winner().name == "LinearRegression" and report.winner().metrics["r2"] > 0.98
    assert sum(m.is_winner for m in report.models) == 1 and all(m.train_seconds > 0 for m in report.models)
    drawn = comparison_figure(spark, report)
    assert drawn["data"][0]["x"][0] == "LinearRegression" and drawn["layout"]["title"]["text"] == "R² by model"


def test_train_binary(samples):
    report = train_models(samples, "yes", ["f1", "f2"], "id")
    assert {m.name for m in report.models} == {"LogisticRegression", "RandomForestClassifier", "GBTClassifier"}
    assert report.winner().metrics["accuracy"] > 0.9 and all(set(m.metrics) == {"accuracy", "f1_macro", "roc_auc"} for m in report.models)


def test_train_multiclass_samples_rows(samples):
    report = train_models(samples, "three", ["f1", "c"], "id", max_rows=200)
    assert report.error is None and (report.rows_used, report.rows_total, report.downsampled) == (200, 240, True)
    assert report.note == "Downsampled from 240 to 200 rows for training."
    assert report.winner().metrics["accuracy"] > 0.8 and all("roc_auc" not in m.metrics for m in report.models)


@pytest.mark.parametrize("target, max_rows, fitted", [("y", 100, 192), ("yes", 100, 80), ("yes", None, 192), ("three", 300, 192)])
def test_all_rows_are_split_and_only_classifiers_fit_on_a_bound(samples, monkeypatch, target, max_rows, fitted):
    from firstlook.models import boosting, train

    seen, fit_one = [], train._fit_one
    monkeypatch.setattr(train, "_fit_one", lambda n, e, fit, test, p: seen.append((fit.count(), test.count())) or fit_one(n, e, fit, test, p))
    report = train_models(samples, target, ["f1", "f2"], "id", max_rows=max_rows)
    assert report.error is None and seen == [(fitted, 48)] * 3
    assert (report.rows_fitted, report.rows_scored, report.rows_total) == (fitted, 48, 240)
    assert report.downsampled == (fitted < 192) and report.rows_used == (100 if fitted < 192 else 240)


@pytest.mark.parametrize("target, features, words", [
    ("zz", ["f1"], "not in DataFrame"), ("y", ["f1", "zz"], "Unknown feature"), ("y", [], "No usable features"),
    ("y", ["y", "f1"], "cannot also be a feature"), ("y", ["word"], "No usable features"), ("word", ["f1"], "Text targets"),
])
def test_guards(samples, target, features, words):
    report = train_models(samples, target, features, "id")
    assert words in report.error and report.models == []


def test_too_few_rows_and_lone_classes(spark, samples):
    assert "too small" in train_models(samples.limit(15), "y", ["f1"], "id").error
    lone = samples.withColumn("k", F.when(F.col("id") == 3, "rare").otherwise(F.col("c")))
    assert train_models(lone, "k", ["f1"], "id").error.startswith("Failed to split data")


@pytest.mark.parametrize("sure", [6, 0.01])
def test_the_split_marks_rows_without_moving_them(spark, monkeypatch, sure):
    from firstlook.models import split

    monkeypatch.setattr(split, "SURE", sure)
    df = spark.range(3001).select("id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 3 == 0, F.lit(None)).otherwise("often").alias("c"), F.lit("x").alias("_place"))
    marked = split.split_rows(df, "id", "c")
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and marked.columns == [*df.columns, "is_test"]
    hashed = marked.withColumn("h", split.row_hash("id")).toPandas()
    quotas = split.test_quotas({None if c != c else c: n for c, n in hashed.c.value_counts(dropna=False).items()})
    for c, rows in hashed.groupby("c", dropna=False):
        tested = rows[rows.is_test]
        assert len(tested) == quotas[None if c != c else c] and tested.h.max() < rows[~rows.is_test].h.min()
    assert split.split_rows(df, "id").where("is_test").count() == 601
