"""Chart points and chart suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from firstlook.operators.adhoc import run_query
from firstlook.operators.charts import chart_points, figure, figure_table, ordered_points
from firstlook.plans.quantiles import grouped_quantile
from firstlook.operators.suggest import chart_scores, suggest_charts

from .insights import KINDS, of_kind
from .tables import rounded, table, union_all

SQL_AGGREGATES = {
    "sum": "round(coalesce(sum(o_totalprice), 0), 2)", "mean": "round(avg(o_totalprice), 4)",
    "median": "round(quantile_cont(o_totalprice, 0.5), 4)", "min": "min(o_totalprice)", "max": "max(o_totalprice)",
}


def chart_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_points(table(spark, sf_dir, "orders"), "o_orderpriority")


def _chart(aggregation: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = chart_points(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", aggregation)
        return rounded(points, 2 if aggregation == "sum" else 4)
    return query


def chart_median_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return rounded(chart_points(lines, "l_partkey", "l_extendedprice", "median"), 4)


def chart_points_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ordered_points(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "sum", "line")
    return points.select(F.date_format("x", "yyyy-MM-dd").alias("x"), F.round("y", 2).alias("y"))


def _half_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "n/a")
        .when(F.col("o_orderstatus") != "F", F.col("o_custkey").cast("string")).alias("amount"),
    )


def chart_null_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(chart_points(_half_known(spark, sf_dir), "priority", "amount", "sum"))


def chart_skip_null_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(chart_points(_half_known(spark, sf_dir), "priority", "amount", "mean", skip_null_y=True))


def chart_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = figure(table(spark, sf_dir, "events"), "bar", "event_type", "user_id", "sum", "users")
    trace = drawn["data"][0]
    rows = [(i, x, float(y)) for i, (x, y) in enumerate(zip(trace["x"], trace["y"]))]
    return spark.createDataFrame(rows, "position int, x string, y double")


def _suggest(name: str, charts: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(suggest_charts(table(spark, sf_dir, name), max_charts=charts))
    return query


def chart_scores_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(chart_scores(table(spark, sf_dir, "lineitem"), KINDS["lineitem"]))


def scores_sql(name: str) -> str:
    """Score of every candidate chart of a table."""
    dates, numbers, categories = (of_kind(name, *k) for k in (("datetime",), ("integer", "float"), ("categorical",)))
    charts = [("line", f"{n} over time", d, n, "sum") for d in dates for n in numbers]
    charts += [("bar", f"avg {n} by {c}", c, n, "mean") for c in categories for n in numbers]
    charts += [("pie", f"{c} distribution", c, None, "count") for c in categories]

    def one(kind: str, title: str, x: str, y: str | None, aggregation: str) -> str:
        value = {"sum": f"coalesce(sum(CAST({y} AS DOUBLE)), 0)", "mean": f"avg(CAST({y} AS DOUBLE))", "count": "CAST(count(*) AS DOUBLE)"}[aggregation]
        y_column = f"'{y}'" if y else "CAST(NULL AS VARCHAR)"
        return f"""SELECT '{kind}' AS type, '{title}' AS title, '{x}' AS x_column, {y_column} AS y_column, '{aggregation}' AS aggregation,
            CASE WHEN count(y) < 2 OR avg(y) = 0 THEN 0.0
                 ELSE stddev_samp(y) / abs(avg(y)) + 0.5 * log2(greatest(count(DISTINCT y), 2)) END AS score
        FROM (SELECT {value} AS y FROM {name} WHERE {x} IS NOT NULL GROUP BY {x})"""
    return union_all([one(*c) for c in charts])


def _suggest_sql(name: str, charts: int) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY score DESC, type, x_column, y_column NULLS FIRST) AS INTEGER) AS rank,
        type, title, x_column, y_column, aggregation, round(score, 6) AS score FROM ({scores_sql(name)})
        ORDER BY rank LIMIT {charts}"""


HALF_KNOWN = """(SELECT CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a' WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS VARCHAR) END AS amount FROM orders)"""

def _drawn(spark: SparkSession, drawn: dict) -> DataFrame:
    """A figure's points with its kind and title."""
    title = drawn["layout"]["title"]["text"]
    if not drawn["data"]:
        return spark.createDataFrame([("none", title, None, None)], "kind string, title string, x string, y double")
    trace = drawn["data"][0]
    pairs = zip(trace["labels"], trace["values"]) if trace["type"] == "pie" else zip(trace["x"], trace["y"])
    rows = [(trace["type"], title, str(x), round(float(y), 2)) for x, y in pairs]
    return spark.createDataFrame(rows, "kind string, title string, x string, y double")


def chart_figure_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, figure(table(spark, sf_dir, "orders"), "line", "o_orderdate", "o_totalprice", "sum", "Prices"))


def chart_figure_pie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, figure(table(spark, sf_dir, "lineitem"), "pie", "l_returnflag", title="Flags"))


def chart_figure_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = table(spark, sf_dir, "lineitem").where("l_quantity < 0")
    return _drawn(spark, figure(nothing, "bar", "l_returnflag", "l_quantity", "sum", "Flags"))


def auto_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chart that an ad-hoc result of one text and one number brings along."""
    answer = run_query(table(spark, sf_dir, "part"), "SELECT p_brand, sum(p_size) AS size FROM {df} GROUP BY p_brand", timeout_s=300)
    return _drawn(spark, answer.figure)


def chart_figure_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line with a point for every order line: its value over the order and line number."""
    lines = table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return figure_table(lines, "line", "l_quantity", "sum", "line")


def chart_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = figure_table(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", "sum", "line", bucket="month")
    return drawn.withColumn("x", F.date_format("x", "yyyy-MM-dd"))


def chart_median_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of two groups, one of which holds most lines, by the way of large groups."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") == 7).alias("x"), F.col("l_extendedprice").alias("y"))
    found = grouped_quantile(lines, "x", "y", 0.5, limit=100)
    return found.select("x", F.round("quantile", 4).alias("y"))


QUERIES = {
    "chart_count": (chart_count, "SELECT o_orderpriority AS x, count(*) AS y FROM orders GROUP BY 1"),
    **{
        f"chart_{a}": (_chart(a), f"SELECT o_orderpriority AS x, {sql} AS y FROM orders GROUP BY 1")
        for a, sql in SQL_AGGREGATES.items()
    },
    "chart_median_hot": (chart_median_hot, "SELECT l_linenumber = 7 AS x, round(quantile_cont(l_extendedprice, 0.5), 4) AS y FROM lineitem GROUP BY 1"),
    "chart_median_high": (chart_median_high, "SELECT l_partkey AS x, round(quantile_cont(l_extendedprice, 0.5), 4) AS y FROM lineitem GROUP BY 1"),
    "chart_points_sorted": (chart_points_sorted, "SELECT strftime(o_orderdate, '%Y-%m-%d') AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY o_orderdate"),
    "chart_null_y": (chart_null_y, f"SELECT priority AS x, round(coalesce(sum(try_cast(amount AS DOUBLE)), 0), 6) AS y FROM {HALF_KNOWN} GROUP BY 1"),
    "chart_skip_null_y": (chart_skip_null_y, f"""SELECT priority AS x, round(avg(try_cast(amount AS DOUBLE)), 6) AS y FROM {HALF_KNOWN}
        WHERE priority <> '' AND try_cast(amount AS DOUBLE) IS NOT NULL GROUP BY 1"""),
    "chart_figure": (chart_figure, """SELECT CAST(row_number() OVER (ORDER BY sum(user_id) DESC, event_type) - 1 AS INTEGER) AS position,
        event_type AS x, CAST(sum(user_id) AS DOUBLE) AS y FROM events GROUP BY event_type"""),
    "chart_figure_line": (chart_figure_line, """SELECT 'scatter' AS kind, 'Prices' AS title, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS x,
        round(sum(o_totalprice), 2) AS y FROM orders GROUP BY o_orderdate"""),
    "chart_figure_pie": (chart_figure_pie, "SELECT 'pie' AS kind, 'Flags' AS title, l_returnflag AS x, CAST(count(*) AS DOUBLE) AS y FROM lineitem GROUP BY 3"),
    "chart_figure_empty": (chart_figure_empty, """SELECT 'none' AS kind, 'Flags (no data)' AS title, CAST(NULL AS VARCHAR) AS x, CAST(NULL AS DOUBLE) AS y
        FROM lineitem HAVING count(*) FILTER (l_quantity < 0) = 0"""),
    "auto_chart": (auto_chart, "SELECT 'bar' AS kind, 'size by p_brand' AS title, p_brand AS x, CAST(sum(p_size) AS DOUBLE) AS y FROM part GROUP BY p_brand"),
    "chart_figure_points": (chart_figure_points, """SELECT row_number() OVER (ORDER BY x) - 1 AS position, x, y FROM (
        SELECT l_orderkey * 8 + l_linenumber AS x, sum(l_quantity) AS y FROM lineitem GROUP BY 1)"""),
    "chart_bucketed": (chart_bucketed, """SELECT row_number() OVER (ORDER BY x) - 1 AS position, x, y FROM (
        SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS x, sum(l_quantity) AS y FROM lineitem GROUP BY 1)"""),
    "suggest_charts": (_suggest("orders", 8), _suggest_sql("orders", 8)),
    "suggest_charts_events": (_suggest("events", 20), _suggest_sql("events", 20)),
    "chart_scores": (chart_scores_lineitem, f"SELECT x_column, y_column, aggregation, round(score, 6) AS score FROM ({scores_sql('lineitem')})"),
}
