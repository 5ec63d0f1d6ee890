"""Statistics, correlations, trends, category gaps and sentences, against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firstlook.operators.breakdowns import breakdowns
from firstlook.operators.correlations import correlations
from firstlook.operators.insights import insights, report_table
from firstlook.operators.sentences import distribution_sentence, sentences
from firstlook.operators.stats import (
    categorical_stats, column_stats, datetime_stats, numeric_stats, overview, stats_report, text_stats,
)
from firstlook.operators.trends import trends, widest_datetime


def test_numeric_stats_match_pandas(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.normal(size=500), "b": rng.pareto(2, 500), "c": np.full(500, 4.0), "n": rng.integers(0, 9, 500)})
    frame.loc[::7, "a"] = np.nan
    got = {r["column"]: r for r in numeric_stats(spark.createDataFrame(frame), list(frame)).collect()}
    for name in frame:
        s = frame[name].dropna()
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        outside = 0 if q1 == q3 else int(((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum())
        want = {
            "count": len(s), "mean": s.mean(), "median": s.median(), "std": s.std(), "min": s.min(), "max": s.max(),
            "q25": q1, "q75": q3, "skew": s.skew(), "outliers_iqr": outside,
        }
        for stat, value in want.items():
            assert got[name][stat] == pytest.approx(value, rel=1e-9, abs=1e-12), (name, stat)


def test_numeric_stats_of_few_values(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, None)], "a double, b double, c double")
    got = {r["column"]: r.asDict() for r in numeric_stats(df, ["a", "b", "c"]).collect()}
    assert got["a"]["skew"] is None and got["a"]["outliers_iqr"] == 0
    assert got["b"]["count"] == 0 and got["b"]["mean"] is None
    assert got["c"]["std"] is None and got["c"]["median"] == 5.0


def test_category_text_and_date_stats(spark):
    df = spark.createDataFrame(
        [("x", True, "héllo", dt.datetime(2024, 1, 1, 23, 30)), ("y", None, "ab", dt.datetime(2024, 1, 3, 23, 0)), ("y", False, None, None),
         ("x", False, "ab", None)], "c string, b boolean, t string, d timestamp_ntz")
    got = {r["column"]: tuple(r)[1:] for r in categorical_stats(df, ["c", "b"]).collect()}
    assert got == {"c": (4, 2, "x", 2, 50.0), "b": (3, 2, "False", 2, pytest.approx(200 / 3))}
    assert tuple(text_stats(df, ["t"]).first()) == ("t", 3, 2, 3.0, 5.0)
    assert tuple(datetime_stats(df, ["d"]).first()) == ("d", 2, "2024-01-01T23:30:00", "2024-01-03T23:00:00", 1)


def test_stats_report_has_an_entry_per_column(spark):
    df = spark.createDataFrame([(None, None, None, "a", 1)], "n double, c string, d timestamp_ntz, t string, i int")
    report = stats_report(df, {"n": "float", "c": "categorical", "d": "datetime", "t": "text", "i": "integer"})
    assert report["n"]["stats"] == report["d"]["stats"] == {"count": 0}
    assert report["c"]["stats"] == {"count": 0, "unique": 0} and report["t"]["stats"]["unique"] == 1
    assert column_stats(df, {"t": "text", "i": "integer"}).where("stat = 'count'").count() == 2


def test_overview(spark):
    df = spark.createDataFrame([(1, 2, "a")], "a int, b int, c string")
    assert {tuple(r) for r in overview(df).collect()} == {(1, 3, "integer", 2), (1, 3, "text", 1)}


def test_many_gappy_columns_in_one_scan(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(400, 5))
    frame = pd.DataFrame({f"c{k:02d}": base[:, k % 5] * (k + 1) + rng.normal(size=400) * (k % 7) + 1e6 * k for k in range(40)})
    frame["same"] = 0.1
    frame = frame.mask(rng.random(frame.shape) < 0.3)
    frame["same_where_c00"] = np.where(frame.c00.notna(), 5.3, rng.normal(size=400))
    df = spark.createDataFrame(frame).replace(float("nan"), None).repartition(4)
    got = {(r["a"], r["b"]): r["r"] for r in correlations(df, list(frame), 0.3).collect()}
    names, all_r = sorted(frame), frame.corr()
    want = {(a, b): all_r.loc[a, b] for i, a in enumerate(names) for b in names[i + 1 :] if abs(all_r.loc[a, b]) >= 0.3}
    want = {k: v for k, v in want.items() if k != ("c00", "same_where_c00")}  # constant where both are there
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = correlations(df, list(frame), 0.3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("MapInArrow") == 1


def test_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    frame = pd.DataFrame({"x": x, "b": 2 * x + rng.normal(size=300) * 0.1, "a": -x + rng.normal(size=300), "k": np.ones(300)})
    frame.loc[::3, "a"] = np.nan
    frame.loc[1::3, "b"] = np.nan
    got = [tuple(r) for r in correlations(spark.createDataFrame(frame), list(frame), 0.5).collect()]
    want = frame.corr()
    pairs = {frozenset((a, b)): abs(want.loc[a, b]) for a in "abx" for b in "abx" if a < b}
    assert [frozenset((a, b)) for a, b, _ in got] == sorted((p for p in pairs if pairs[p] >= 0.5), key=lambda p: -pairs[p])
    for a, b, r in got:
        assert a < b and r == pytest.approx(want.loc[a, b])
    assert [abs(r) for *_, r in got] == sorted((abs(r) for *_, r in got), reverse=True)
    assert correlations(spark.createDataFrame(frame), ["x"], 0.5).count() == 0


def month_rows(spark, values):
    return spark.createDataFrame([(dt.datetime(2023, m, 10), v) for m, v in values], "day timestamp_ntz, amount double")


def test_trend_compares_first_and_last_quarter_of_the_axis(spark):
    df = month_rows(spark, [(1, 90.0), (2, 10.0), (4, 5.0), (6, 5.0), (8, 1.0), (11, 20.0), (12, 5.0)])
    row = trends(df, {"day": "datetime", "amount": "float"}).first()
    assert (row["first_value"], row["last_value"], row["pct_change"], row["direction"]) == (100.0, 25.0, -75.0, "down")
    assert (row["first_period"], row["last_period"]) == ("2023-01", "2023-09")


def test_trend_matches_pandas_cut(spark):
    rng = np.random.default_rng(4)
    days = pd.Timestamp("2022-01-01") + pd.to_timedelta(rng.integers(0, 1000, 400), "D")
    frame = pd.DataFrame({"day": days, "v": rng.normal(10, 3, 400)})
    periods = pd.cut(frame.day, pd.date_range(frame.day.min(), frame.day.max(), periods=5), include_lowest=True)
    sums = frame.groupby(periods, observed=True).v.sum()
    row = trends(spark.createDataFrame(frame), {"day": "datetime", "v": "float"}).first()
    assert row["first_value"] == pytest.approx(sums.iloc[0]) and row["last_value"] == pytest.approx(sums.iloc[-1])


def test_trend_rules(spark):
    zero = month_rows(spark, [(1, 0.0), (12, 0.0)])
    assert trends(zero, {"day": "datetime", "amount": "float"}).count() == 0
    once = month_rows(spark, [(1, 5.0), (1, 6.0)])
    assert trends(once, {"day": "datetime", "amount": "float"}).count() == 0
    assert trends(once.select("amount"), {"amount": "float"}).count() == 0
    last_zero = month_rows(spark, [(1, 5.0), (6, 2.0), (12, 0.0)])
    assert trends(last_zero, {"day": "datetime", "amount": "float"}).first()["pct_change"] == -100.0


def test_widest_date_column_wins(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "2024-01-01"), (dt.date(2024, 1, 9), "10/1/2024")], "near date, far string")
    assert widest_datetime(df, ["near", "far"]).column == "far"
    same = df.withColumn("also", F.col("near"))
    assert widest_datetime(same, ["also", "near"]).column == "also" and widest_datetime(df, []) is None


def test_breakdown_picks_best_and_worst(spark):
    df = spark.createDataFrame(
        [("N", 10.0, True), ("N", 30.0, None), ("S", 5.0, False), ("E", 20.0, True), ("W", 5.0, None), (None, 900.0, None)],
        "region string, sales double, flag boolean")
    rows = breakdowns(df, {"region": "categorical", "sales": "float", "flag": "boolean"}).collect()
    assert [tuple(r) for r in rows] == [
        ("region", "sales", "E", 20.0, "W", 5.0, 300.0), ("flag", "sales", "True", 15.0, "False", 5.0, 200.0)]


def test_breakdown_skips_single_groups_and_zero_means(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), ("a", 0.0, "z")], "one string, n double, c string")
    assert breakdowns(df, {"one": "categorical", "n": "float", "c": "categorical"}).count() == 0


TREND = {"column": "sales", "first_period": "2024-Q1", "last_period": "2024-Q4", "pct_change": -12.34, "direction": "down"}
PAIR = {"a": "x", "b": "y", "r": -0.82}
GAP = {"category_col": "region", "numeric_col": "sales", "top": {"value": "N"}, "bottom": {"value": "S"}, "pct_diff": 41.0}


def test_sentences_and_their_order():
    columns = {"v": {"type": "float", "stats": {"count": 100, "skew": -1.5, "outliers_iqr": 8}}, "t": {"type": "text", "stats": {"count": 3}}}
    assert sentences([TREND], [PAIR], [GAP], columns) == [
        "sales decreased 12.3% from 2024-Q1 to 2024-Q4.",
        "x and y are strongly negatively correlated (r=-0.82).",
        "region 'N' has 41.0% higher average sales than 'S'.",
        "v is left-skewed (skew=-1.50); 8 IQR-outlier values (8%).",
    ]
    assert sentences([TREND] * 20, [PAIR], [], {}) == ["sales decreased 12.3% from 2024-Q1 to 2024-Q4."] * 10
    assert "moderately positively" in sentences([], [PAIR | {"r": 0.6999}], [], {})[0]
    assert "lower average" in sentences([], [], [GAP | {"pct_diff": -3.0}], {})[0]


def test_plain_distributions_have_no_sentence():
    assert distribution_sentence("v", {"count": 100, "skew": 1.0, "outliers_iqr": 5}) is None
    assert distribution_sentence("v", {"count": 0}) is None


def test_insights_of_the_cleaned_table(spark, cleaned):
    report = insights(cleaned.table)
    frame = cleaned.table.toPandas()
    assert report.schema["rows"] == 240 and report.schema["cols"] == 7
    assert report.columns["weight_kg"]["stats"]["std"] == pytest.approx(frame.weight_kg.std())
    assert report.columns["weight_kg"]["stats"]["skew"] == pytest.approx(frame.weight_kg.skew())
    best = frame.groupby("depot").weight_kg.mean().sort_values()
    gap = next(g for g in report.category_breakdowns if (g["category_col"], g["numeric_col"]) == ("depot", "weight_kg"))
    assert gap["bottom"]["mean"] == round(best.iloc[0], 4) and gap["top"]["mean"] == round(best.iloc[-1], 4)
    assert report.trends[0]["period_col"] == "sent_on" and 0 < len(report.insight_sentences) <= 10
    assert {r["section"] for r in report_table(spark, report.to_dict()).collect()} == set(report.to_dict())
