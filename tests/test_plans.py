"""Ordered fills, running totals and exact quantiles, against pandas, with hot groups and values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firstlook.plans import quantiles as exact
from firstlook.plans.ordered import OrderError, add_chunk, fill_in_order, running_total


def test_chunks_rise_with_the_order(spark):
    df = spark.range(10_000).select(((F.col("id") * 7919) % 10_007).alias("k"))
    ends = add_chunk(df, "k", chunks=16).groupBy("_chunk").agg(F.min("k").alias("a"), F.max("k").alias("z"), F.count("k").alias("n"))
    rows = sorted(tuple(r) for r in ends.select("a", "z", "n").collect())
    assert len(rows) > 8 and all(left[1] < right[0] for left, right in zip(rows, rows[1:]))
    assert max(r[2] for r in rows) < 3 * 10_000 / 16


def test_no_rows_have_chunks_too(spark):
    none = spark.range(0).select(F.col("id").alias("k"), F.lit(None).cast("int").alias("v"))
    assert add_chunk(none, "k").collect() == [] == fill_in_order(none, ["v"], "k").collect()


@pytest.mark.parametrize("seed", [0, 1])
def test_fill_matches_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    n = 2_000
    frame = pd.DataFrame({"k": rng.permutation(n) * 3, "v": rng.normal(size=n).round(3), "w": rng.integers(0, 9, n).astype(float)})
    frame.loc[rng.random(n) < 0.9, "v"] = np.nan
    frame.loc[frame.k < 900, "w"] = np.nan
    df = spark.createDataFrame(frame).replace(float("nan"), None).repartition(5)
    got = fill_in_order(df, ["v", "w"], "k").toPandas().sort_values("k", ignore_index=True)
    want = frame.sort_values("k", ignore_index=True)
    want[["v", "w"]] = want[["v", "w"]].ffill().bfill()
    pd.testing.assert_frame_equal(got, want)


def test_fill_by_time_and_all_missing(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id) AS k, CAST(NULL AS INT) AS v, "
                   "CASE WHEN id % 5 = 2 THEN id END AS w FROM range(50)".replace("FROM range(50)", "FROM range(50) t(id)"
                   ).replace("make_dt_interval(id)", "make_dt_interval(CAST(id AS INT))"))
    got = fill_in_order(df, ["v", "w"], "k").orderBy("k").collect()
    assert [r["v"] for r in got] == [None] * 50
    assert [r["w"] for r in got][:8] == [2, 2, 2, 2, 2, 2, 2, 7]


def test_fill_keeps_columns_of_any_name_and_checks_the_order_in_the_same_sort(spark):
    rows = [(k, None if k % 3 else float(k), "c", "s", "p") for k in range(60)]
    df = spark.createDataFrame(rows, "k long, v double, _chunk string, _seen0 string, _position string").repartition(4)
    got = fill_in_order(df, ["v"], "k", checked=True)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [(k, float(k - k % 3), "c", "s", "p") for k in range(60)]
    for extra, what in ((7, "repeats values"), (None, "has missing values")):
        more = df.union(spark.createDataFrame([(extra, 1.0, "c", "s", "p")], df.schema))
        with pytest.raises(OrderError, match=what):
            fill_in_order(more, ["v"], "k", checked=True)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange shufflepartitionidpassthrough") == 1 and "hashpartitioning" not in plan


def test_text_is_no_order(spark):
    with pytest.raises(ValueError, match="order column"):
        fill_in_order(spark.createDataFrame([("a", 1)], "k string, v int"), ["v"], "k")


@pytest.mark.parametrize("small_bytes", [2**28, 0])
def test_running_total_with_a_hot_group(spark, monkeypatch, small_bytes):
    monkeypatch.setattr("firstlook.plans.reuse.SMALL_BYTES", small_bytes)
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": rng.choice(["hot", "a", "b", None], 3_000, p=[0.7, 0.1, 0.1, 0.1]), "k": np.arange(3_000), "v": rng.integers(0, 5, 3_000)})
    got = running_total(spark.createDataFrame(frame).repartition(4), "k", "v", by=["g"]).toPandas().sort_values("k", ignore_index=True)
    want = frame.groupby("g", dropna=False).v.cumsum() - frame.v
    assert got.before.tolist() == want.tolist()


VALUES = {
    "spread": lambda rng: rng.normal(size=5_000) * 1e6,
    "hot": lambda rng: np.where(rng.random(5_000) < 0.4, 7.0, rng.normal(7, 1, 5_000)),
    "edge": lambda rng: np.concatenate([np.zeros(2_500), rng.random(2_500) + 1]),
    "heavy": lambda rng: rng.pareto(0.3, 5_000),
    "few": lambda rng: rng.integers(0, 7, 5_000).astype(float),
    "constant": lambda rng: np.full(5_000, 3.5),
}


@pytest.mark.parametrize("limit, sketch_k", [(10**6, 4000), (50, 200), (5, 60)])
def test_quantiles_are_exact(spark, limit, sketch_k):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({name: make(rng) for name, make in VALUES.items()})
    frame.loc[::11, "spread"] = np.nan
    df = spark.createDataFrame(frame).replace(float("nan"), None).repartition(6)
    fractions = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    found = exact.quantiles(df, list(VALUES), fractions, limit=limit, sketch_k=sketch_k)
    for c in VALUES:
        for f in fractions:
            assert found[c, f] == pytest.approx(frame[c].quantile(f), rel=1e-9, abs=1e-9), (c, f)


def test_infinite_values_are_values(spark):
    df = spark.createDataFrame([(float(x),) for x in ["-inf", *range(9), "inf", "inf"]], "v double")
    assert exact.quantiles(df, ["v"], [0.0, 0.5, 1.0]) == {("v", 0.0): float("-inf"), ("v", 0.5): 4.5, ("v", 1.0): float("inf")}


def test_brackets_are_narrow_and_two_jobs_answer_any_number_of_columns(spark):
    df = spark.range(20_000).select(*[F.rand(k).alias(f"v{k}") for k in range(12)])
    _, found = exact.first_brackets(df, df.columns, [0.25, 0.5])
    assert all(0 < b.high - b.low < 0.02 and b.between < 200 for b in found.values())
    context, group = spark.sparkContext, "quantile-jobs"
    context.setJobGroup(group, "")
    exact.quantiles(df, df.columns, [0.25, 0.5, 0.75], limit=500)
    # Adaptive execution runs a job for each shuffle and broadcast, and one for each result.
    jobs = context.statusTracker().getJobIdsForGroup(group)
    context._jsc.clearJobGroup()
    assert len(jobs) <= 6


def test_quantiles_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(None, 4.0), (None, None)], "a double, b double")
    assert exact.quantiles(df, ["a", "b"], [0.5]) == {("a", 0.5): None, ("b", 0.5): 4.0}


@pytest.mark.parametrize("limit", [50_000, 20])
def test_grouped_quantile_with_a_hot_group(spark, limit):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"g": rng.choice(["hot", "b", "c"], 4_000, p=[0.9, 0.05, 0.05]), "v": rng.normal(size=4_000).round(2)})
    frame.loc[frame.g == "c", "v"] = np.nan
    df = spark.createDataFrame(frame).replace(float("nan"), None).repartition(4)
    got = {r["g"]: r["quantile"] for r in exact.grouped_quantile(df, "g", "v", 0.5, limit).collect()}
    want = frame.groupby("g").v.median()
    assert got["c"] is None and got["hot"] == pytest.approx(want["hot"]) and got["b"] == pytest.approx(want["b"])


def test_no_window_over_all_rows(spark):
    """The only one-task window is over the chunk table, after an aggregate."""
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    plan = fill_in_order(df, ["v"], "id")._jdf.queryExecution().executedPlan().toString()
    before_single = plan.split("Exchange SinglePartition")
    assert len(before_single) == 2 and before_single[1].lstrip(", ").split("\n")[1].find("HashAggregate") >= 0
