"""Descriptions, ad-hoc queries, sessions and replies."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from firstlook.operators.sample import exact_sample
from firstlook.operators.adhoc import format_result, run_query
from firstlook.operators.describe import column_details, describe, first_values
from firstlook.operators.sessions import parse_replies, prompts, recent_history, system_prompt


@pytest.fixture(scope="module")
def trips(spark):
    rows = [(i, "bac"[i % 3], f"a rather long remark about trip number {i}", i * 1.5, dt.datetime(2024, 1, 1 + i)) for i in range(12)]
    return spark.createDataFrame(rows, "id int, kind string, remark string, km double, day timestamp_ntz").repartition(3)


def test_first_values_in_row_order(spark):
    df = spark.range(5000).select("id", F.format_string("v%d", (F.lit(4999) - F.col("id")) % 10).alias("c")).repartition(4)
    rows = first_values(df, ["c"], "id").orderBy("rank").collect()
    assert [r["value"] for r in rows] == ["v9", "v8", "v7", "v6", "v5", "v4", "v3", "v2"]


def test_description(trips):
    text = describe(trips, "id")
    assert text.startswith("The table has 12 rows and 5 columns.\nColumns:\n  id (integer), range 0..11\n")
    assert "  kind (categorical), values: ['b', 'a', 'c']\n" in text
    assert "  remark (text), sample: 'a rather long remark about tri...'\n" in text
    assert "  km (float), range 0..16.5\n  day (datetime), range 2024-01-01..2024-01-12\n" in text
    sample = json.loads(text.split("Sample rows (3):\n")[1])
    assert [s["id"] for s in sample] == [0, 1, 2] and sample[1]["day"] == "2024-01-02T00:00:00"


def test_details_without_values(spark):
    df = spark.createDataFrame([(1, None)], "k int, n double")
    assert column_details(df, {"k": "integer", "n": "float"}, "k").orderBy("position").collect()[1]["detail"] is None


def test_sql_and_function_queries(trips):
    total = run_query(trips, "SELECT sum(km) AS total FROM {df}")
    assert (total.result.type, total.result.value, total.figure) == ("scalar", 99.0, None)
    grouped = run_query(trips, lambda df: df.groupBy("kind").agg(F.sum("km").alias("km")))
    assert grouped.result.type == "dataframe" and grouped.result.columns == ["kind", "km"] and len(grouped.result.records) == 3
    assert grouped.figure["data"][0]["type"] == "bar" and grouped.figure["layout"]["title"]["text"] == "km by kind"
    daily = run_query(trips, "SELECT day, sum(km) AS km FROM {df} GROUP BY day")
    assert daily.figure["data"][0]["type"] == "scatter"
    assert run_query(trips, "SELECT id, km FROM {df}").figure is None
    assert run_query(trips, "SELECT kind, km, id FROM {df}").figure is None
    assert run_query(trips, "SELECT kind FROM {df} WHERE km < 0").result.records == []


def test_results_are_cut_after_the_query(spark):
    found = run_query(spark.range(2500).withColumn("c", F.lit("x")), "SELECT * FROM {df}").result
    assert len(found.records) == 1000 and found.truncated
    assert not run_query(spark.range(1000).withColumn("c", F.lit("x")), "SELECT * FROM {df}").result.truncated
    assert run_query(spark.range(2500), "SELECT count(*) AS n FROM {df}").result.value == 2500


@pytest.mark.parametrize("value, kind, expected", [
    (None, "none", None), (True, "scalar", True), (3, "scalar", 3), (float("nan"), "scalar", None), (2.5, "scalar", 2.5),
    ("x", "scalar", "x"), (dt.date(2024, 1, 1), "scalar", "2024-01-01"),
])
def test_plain_results(value, kind, expected):
    found = format_result(value).result
    assert (found.type, found.value) == (kind, expected)


def test_failures_become_errors(trips):
    assert "nope" in run_query(trips, "SELECT nope FROM {df}").error
    assert run_query(trips, lambda df: 1 / 0).error.startswith("ZeroDivisionError")


def test_the_limit_holds_for_whatever_comes_after_it(spark):
    """A function that sleeps past the limit and then returns, or runs, something heavy."""
    table = spark.range(0, 60_000_000_000, 1, 6000)  # minutes of work in short tasks
    heavy = lambda df: df.groupBy((F.xxhash64("id") % 7).alias("k")).count()

    def late(then):
        def query(df):
            time.sleep(1.5)
            return then(heavy(df))
        return query

    for then in (lambda t: t, lambda t: t.collect(), lambda t: [t.count() for _ in range(9)]):
        start = time.time()
        found = run_query(table, late(then), timeout_s=1)
        assert found.error.startswith("TimeoutError") and time.time() - start < 2
    start = time.time()
    assert run_query(table, lambda df: heavy(df).collect(), timeout_s=1).error.startswith("TimeoutError") and time.time() - start < 2
    time.sleep(2.5)
    assert not [i for i in spark.sparkContext.statusTracker().getActiveJobsIds()]
    assert run_query(spark.range(5), "SELECT sum(id) AS s FROM {df}").result.value == 10


def test_any_exception_becomes_an_error(trips):
    assert run_query(trips, lambda df: [][1]).error.startswith("IndexError")
    assert run_query(trips, lambda df: next(iter([]))).error.startswith("StopIteration")


def test_a_small_result_is_not_computed_again_for_its_figure(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x: int) -> int:
        seen.add(1)
        return x

    table = spark.range(20).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.udf(counted, "long")("id").alias("n")).coalesce(1)
    found = run_query(table, "SELECT * FROM {df}")
    assert found.figure["data"][0]["y"][0] == 19 and seen.value == 20


def test_recent_history_and_prompts(spark):
    messages = spark.createDataFrame(
        [(s, t, "user" if t % 2 == 0 else "assistant", f"{s}{t}") for s in ("p", "q") for t in range(9 if s == "p" else 2)],
        "session string, turn long, role string, text string")
    kept = recent_history(messages).orderBy("session", "turn").collect()
    assert [r["turn"] for r in kept if r["session"] == "p"] == [3, 4, 5, 6, 7, 8] and len(kept) == 8
    asked = spark.createDataFrame([("q", "why?"), ("new", "hi")], "session string, question string")
    got = {r["session"]: r["messages"] for r in prompts(messages, asked, "A table.").collect()}
    assert [(m["role"], m["content"]) for m in got["q"]] == [
        ("system", system_prompt("A table.")), ("user", "q0"), ("assistant", "q1"), ("user", "why?")]
    assert [m["role"] for m in got["new"]] == ["system", "user"]
    plan = recent_history(messages)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_replies(spark):
    replies = ['{"code": "SELECT 1", "answer": "One."}', '{"code": 5, "answer": null}', "[1]", "no json", '{"answer": "a"}', None]
    got = parse_replies(spark.createDataFrame([(r,) for r in replies], "reply string")).collect()
    assert [(r["code"], r["answer"]) for r in got] == [("SELECT 1", "One."), ("", ""), ("", ""), ("", ""), ("", "a"), ("", "")]
    assert [r["error"] is not None for r in got] == [False, False, True, True, False, True]


def test_a_query_has_a_time_limit(spark):
    slow = F.udf(lambda x: __import__("time").sleep(20) or x, "long")
    found = run_query(spark.range(4).withColumn("c", slow("id")), "SELECT * FROM {df}", timeout_s=2)
    assert found.error == "TimeoutError: the query took longer than 2 seconds"
    assert run_query(spark.range(4), "SELECT count(*) AS n FROM {df}", timeout_s=60).result.value == 4


def test_samples_keep_columns_of_any_name(spark):
    df = spark.range(3000).select("id", F.lit("h").alias("_hash"), F.lit("p").alias("_place"), F.lit(None).alias("nothing"))
    for table in (df, df.drop("nothing")):
        got = exact_sample(table, 40, "id")
        assert got.columns == table.columns and got.count() == 40 and {(r["_hash"], r["_place"]) for r in got.collect()} == {("h", "p")}
    assert [r["id"] for r in exact_sample(df, 40, "id").collect()] == [r["id"] for r in exact_sample(df.drop("nothing"), 40, "id").collect()]
