"""Statistics, correlations, trends, category gaps and sentences."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from firstlook.operators.breakdowns import breakdowns
from firstlook.operators.correlations import correlations
from firstlook.operators.insights import insights, report_table
from firstlook.operators.sentences import sentences_table
from firstlook.operators.stats import categorical_stats, column_stats, datetime_stats, numeric_stats, outliers, text_stats
from firstlook.operators.trends import time_spans, trends

from .tables import rounded, table, union_all

LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Which columns of the tables are what; the test tables keep these types at every scale.
KINDS = {
    "orders": {
        "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "categorical", "o_totalprice": "float",
        "o_orderdate": "datetime", "o_orderpriority": "categorical",
    },
    "lineitem": {
        "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
        "l_quantity": "integer", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
        "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "datetime",
    },
    "events": {
        "event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "categorical", "value": "float",
        "props": "categorical",
    },
}


def of_kind(name: str, *kinds: str) -> list[str]:
    return [c for c, kind in KINDS[name].items() if kind in kinds]


def _skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(price.alias("tax_on_discount"), "l_quantity", "l_extendedprice")


def numeric_stats_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(numeric_stats(table(spark, sf_dir, "lineitem"), LINE_NUMBERS), 4)


def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(_skewed(spark, sf_dir), ["tax_on_discount", "l_quantity", "l_extendedprice"])


def skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["tax_on_discount", "l_quantity", "l_extendedprice"]
    return rounded(numeric_stats(_skewed(spark, sf_dir), names).select("column", "skew"))


def categorical_stats_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(categorical_stats(table(spark, sf_dir, "orders"), of_kind("orders", "categorical")))


def text_stats_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text_stats(table(spark, sf_dir, "documents"), ["text", "lang", "source"]))


def datetime_stats_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datetime_stats(table(spark, sf_dir, "events"), ["ts"])


def column_stats_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(column_stats(table(spark, sf_dir, "orders")), 4)


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_linenumber",
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice") + 3000 * F.col("l_quantity")).alias("price"),
        F.lit(5.0).alias("constant"),
    )


def correlations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correlations(table(spark, sf_dir, "lineitem"), LINE_NUMBERS, 0.0), 8)


def correlations_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correlations(_gappy(spark, sf_dir), ["l_linenumber", "quantity", "price", "constant"]), 8)


def widest_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderdate", F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "M/d/yyyy")).alias("finished"),
        F.make_date(F.lit(2000), F.month("o_orderdate"), F.lit(1)).alias("season"),
    )
    spans = time_spans(orders, ["season", "o_orderdate", "finished"])
    return spans.orderBy(F.col("span_days").desc(), "position").limit(1).select("column", "span_days")


def _trends(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = trends(table(spark, sf_dir, name))
        return found.select(
            "column", "period_col", "first_period", "last_period", "direction",
            *[F.round(c, 2).alias(c) for c in ("first_value", "last_value")], F.round("pct_change", 6).alias("pct_change"),
        )
    return query


def _breakdowns(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(breakdowns(table(spark, sf_dir, name)), 4)
    return query


def sentences_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences_table(spark, insights(table(spark, sf_dir, "orders")).insight_sentences)


def sentences_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences_table(spark, insights(_skewed(spark, sf_dir)).insight_sentences)


def insights_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_table(spark, insights(table(spark, sf_dir, "events")).to_dict())


def numeric_sql(source: str, columns: list[str], digits: int = 4) -> str:
    """One row of statistics per column of a table or subquery, with outliers by quartile fences."""
    def one(c: str) -> str:
        return f"""SELECT '{c}' AS "column", count(v) AS count, round(avg(v), {digits}) AS mean, round(quantile_cont(v, 0.5), {digits}) AS median,
            round(stddev_samp(v), {digits}) AS std, round(min(v), {digits}) AS min, round(max(v), {digits}) AS max,
            round(quantile_cont(v, 0.25), {digits}) AS q25, round(quantile_cont(v, 0.75), {digits}) AS q75, round(skewness(v), {digits}) AS skew,
            (SELECT count(*) FROM (SELECT CAST({c} AS DOUBLE) AS w FROM {source}),
                (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS z FROM {source})
             WHERE w < a - 1.5 * (z - a) OR w > z + 1.5 * (z - a)) AS outliers_iqr
        FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {source})"""
    return union_all([one(c) for c in columns])


def categorical_sql(name: str, columns: list[str]) -> str:
    def one(c: str) -> str:
        return f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique", arg_max(v, (n, -place)) AS top, max(n) AS top_count,
            round(max(n) / sum(n) * 100.0, 6) AS top_pct
        FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY {c}) AS place FROM {name} GROUP BY 1)"""
    return union_all([one(c) for c in columns])


def correlation_sql(source: str, columns: list[str], least: float) -> str:
    pairs = union_all([
        f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER ({b} IS NOT NULL) * stddev_pop({b}) FILTER ({a} IS NOT NULL), 0), 8) AS r FROM {source}"
        for a, b in combinations(sorted(columns), 2)
    ])
    return f"SELECT * FROM ({pairs}) WHERE abs(r) >= {least}"


def trend_sql(name: str, moment: str, columns: list[str]) -> str:
    sums = ", ".join(f"sum(CAST({c} AS DOUBLE)) AS {c}" for c in columns)
    long = union_all([f"SELECT period, {i} AS place, '{c}' AS \"column\", {c} AS total FROM sums" for i, c in enumerate(columns)])

    def label(period: str) -> str:
        edge = f"(lo + to_microseconds(({period} - 1) * span // 4))"
        return f"""CASE WHEN days >= 365 THEN year{edge} || '-Q' || quarter{edge} WHEN days >= 90 THEN strftime({edge}, '%Y-%m')
            ELSE isoyear{edge} || '-W' || lpad(CAST(week{edge} AS VARCHAR), 2, '0') END"""
    return f"""
    axis AS (SELECT min({moment}) AS lo, epoch_us(max({moment})) - epoch_us(min({moment})) AS span, span // 86400000000 AS days FROM {name}),
    sums AS (SELECT greatest(1, ((epoch_us({moment}) - epoch_us(lo)) * 4 + span - 1) // span) AS period, {sums} FROM {name}, axis GROUP BY 1),
    ends AS (SELECT place, "column", min(period) AS a, max(period) AS z, arg_min(total, period) AS first_value, arg_max(total, period) AS last_value,
        count(*) FILTER (total <> 0) AS filled FROM ({long}) WHERE total IS NOT NULL GROUP BY 1, 2),
    changes AS (SELECT place, "column", '{moment}' AS period_col, {label('a')} AS first_period, {label('z')} AS last_period, first_value, last_value,
        (last_value - first_value) / abs(first_value) * 100.0 AS pct_change FROM ends, axis WHERE filled >= 2 AND first_value <> 0)"""


def trends_sql(name: str) -> str:
    moment, = of_kind(name, "datetime")
    return "WITH" + trend_sql(name, moment, of_kind(name, "integer", "float")) + """
    SELECT "column", period_col, first_period, last_period, CASE WHEN pct_change >= 0 THEN 'up' ELSE 'down' END AS direction,
        round(first_value, 2) AS first_value, round(last_value, 2) AS last_value, round(pct_change, 6) AS pct_change FROM changes"""


def gap_sql(name: str, categories: list[str], numerics: list[str]) -> str:
    means = union_all([
        f"SELECT {i * 100 + j} AS place, '{c}' AS category_col, '{n}' AS numeric_col, CAST({c} AS VARCHAR) AS value, avg(CAST({n} AS DOUBLE)) AS mean FROM {name} WHERE {c} IS NOT NULL AND {n} IS NOT NULL GROUP BY {c}"
        for i, c in enumerate(categories) for j, n in enumerate(numerics)
    ])
    return f"""
    means AS ({means}),
    placed AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY mean DESC, value) AS best,
        row_number() OVER (PARTITION BY place ORDER BY mean, value DESC) AS worst, count(*) OVER (PARTITION BY place) AS groups FROM means),
    gaps AS (SELECT place, category_col, numeric_col, max(value) FILTER (best = 1) AS top_value, max(mean) AS top_mean,
        max(value) FILTER (worst = 1) AS bottom_value, min(mean) AS bottom_mean, (max(mean) - min(mean)) / abs(min(mean)) * 100.0 AS pct_diff
        FROM placed WHERE groups >= 2 GROUP BY 1, 2, 3 HAVING min(mean) <> 0)"""


def breakdown_sql(name: str) -> str:
    return "WITH" + gap_sql(name, of_kind(name, "categorical"), of_kind(name, "integer", "float")) + """
    SELECT category_col, numeric_col, top_value, round(top_mean, 4) AS top_mean, bottom_value, round(bottom_mean, 4) AS bottom_mean,
        round(pct_diff, 4) AS pct_diff FROM gaps"""


def _sentences_sql() -> str:
    numbers = of_kind("orders", "integer", "float")
    return "WITH" + trend_sql("orders", "o_orderdate", numbers) + "," + gap_sql("orders", of_kind("orders", "categorical"), numbers) + """,
    worded AS (
        SELECT 1 AS section, abs(round(pct_change, 2)) AS size, place,
            printf('%s %s %.1f%% from %s to %s.', "column", CASE WHEN round(pct_change, 2) >= 0 THEN 'increased' ELSE 'decreased' END,
                abs(round(pct_change, 2)), first_period, last_period) AS sentence FROM changes
        UNION ALL
        SELECT 3, abs(round(pct_diff, 2)), place, printf('%s ''%s'' has %.1f%% %s average %s than ''%s''.', category_col, top_value, abs(round(pct_diff, 2)),
            CASE WHEN round(pct_diff, 2) >= 0 THEN 'higher' ELSE 'lower' END, numeric_col, bottom_value) FROM gaps)
    SELECT CAST(row_number() OVER (ORDER BY section, size DESC, place) AS INTEGER) AS rank, sentence FROM worded
    ORDER BY rank LIMIT 10"""


SKEWED = "(SELECT l_extendedprice * l_discount * l_tax AS tax_on_discount, l_quantity, l_extendedprice FROM lineitem)"
GAPPY = """(SELECT l_linenumber, CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS quantity,
    CASE WHEN l_linestatus = 'O' THEN l_extendedprice + 3000 * l_quantity END AS price, 5.0 AS constant FROM lineitem)"""


def _distribution_sql() -> str:
    """Correlation sentences, then distribution sentences, of the skewed columns."""
    names = ["tax_on_discount", "l_quantity", "l_extendedprice"]
    place = "CASE \"column\" " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + " END"
    return f"""WITH stats AS ({numeric_sql(SKEWED, names, 9)}), pairs AS ({correlation_sql(SKEWED, names, 0.5)}),
        worded AS (
            SELECT 1 AS section, -abs(round(r, 4)) AS size, a || b AS place, printf('%s and %s are %s %s correlated (r=%.2f).', a, b,
                CASE WHEN abs(round(r, 4)) >= 0.7 THEN 'strongly' ELSE 'moderately' END,
                CASE WHEN r >= 0 THEN 'positively' ELSE 'negatively' END, round(r, 4)) AS sentence FROM pairs
            UNION ALL
            SELECT 2, {place}, '', "column" || ' is ' || concat_ws('; ',
                CASE WHEN abs(skew) > 1 THEN printf('%s-skewed (skew=%.2f)', CASE WHEN skew > 0 THEN 'right' ELSE 'left' END, skew) END,
                CASE WHEN outliers_iqr / count > 0.05 THEN printf('%d IQR-outlier values (%.0f%%)', outliers_iqr, outliers_iqr * 100.0 / count) END) || '.'
            FROM stats WHERE abs(skew) > 1 OR outliers_iqr / count > 0.05)
        SELECT CAST(row_number() OVER (ORDER BY section, size, place) AS INTEGER) AS rank, sentence FROM worded"""


def _column_stats_sql() -> str:
    numbers, categories = of_kind("orders", "integer", "float"), of_kind("orders", "categorical")
    stats = ["count", "mean", "median", "std", "min", "max", "q25", "q75", "skew", "outliers_iqr"]
    parts = [
        f"SELECT \"column\", CASE \"column\" WHEN 'o_totalprice' THEN 'float' ELSE 'integer' END AS semantic_type, '{s}' AS stat, CAST({s} AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS label FROM numbers"
        for s in stats
    ]
    parts += [
        f"SELECT \"column\", 'categorical', '{s}', CAST({'NULL' if s == 'top' else 'round(' + chr(34) + s + chr(34) + ', 4)'} AS DOUBLE), {'top' if s == 'top' else 'NULL'} FROM categories"
        for s in ("count", "unique", "top", "top_count", "top_pct")
    ]
    parts += [
        "SELECT 'o_orderdate', 'datetime', 'count', CAST(count(o_orderdate) AS DOUBLE), NULL FROM orders",
        "SELECT 'o_orderdate', 'datetime', 'min', NULL, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') FROM orders",
        "SELECT 'o_orderdate', 'datetime', 'max', NULL, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') FROM orders",
        "SELECT 'o_orderdate', 'datetime', 'span_days', CAST((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) // 86400000000 AS DOUBLE), NULL FROM orders",
    ]
    return f"WITH numbers AS ({numeric_sql('orders', numbers)}), categories AS ({categorical_sql('orders', categories)}) " + union_all(parts)


QUERIES = {
    "numeric_stats": (numeric_stats_lineitem, numeric_sql("lineitem", LINE_NUMBERS)),
    "skew": (skew, f'SELECT "column", skew FROM ({numeric_sql(SKEWED, ["tax_on_discount", "l_quantity", "l_extendedprice"], 6)})'),
    "iqr_outliers": (iqr_outliers, f'SELECT "column", count, outliers_iqr FROM ({numeric_sql(SKEWED, ["tax_on_discount", "l_quantity", "l_extendedprice"])})'),
    "categorical_stats": (categorical_stats_orders, categorical_sql("orders", of_kind("orders", "categorical"))),
    "text_stats": (text_stats_documents, union_all([
        f"SELECT '{c}' AS \"column\", count({c}) AS count, count(DISTINCT {c}) AS \"unique\", round(avg(length({c})), 6) AS avg_length, CAST(max(length({c})) AS DOUBLE) AS max_length FROM documents"
        for c in ("text", "lang", "source")
    ])),
    "datetime_stats": (datetime_stats_events, """SELECT 'ts' AS "column", count(ts) AS count, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS min,
        strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS max, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS span_days FROM events"""),
    "column_stats": (column_stats_orders, _column_stats_sql()),
    "correlations": (correlations_all, correlation_sql("lineitem", LINE_NUMBERS, 0.0)),
    "correlations_gappy": (correlations_gappy, correlation_sql(GAPPY, ["l_linenumber", "quantity", "price", "constant"], 0.5)),
    "widest_datetime": (widest_datetime, """SELECT 'o_orderdate' AS "column", (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) // 86400000000 AS span_days FROM orders"""),
    "trends_orders": (_trends("orders"), trends_sql("orders")),
    "trends_lineitem": (_trends("lineitem"), trends_sql("lineitem")),
    "trends_week": (_trends("events"), trends_sql("events")),
    "breakdowns_orders": (_breakdowns("orders"), breakdown_sql("orders")),
    "breakdowns_lineitem": (_breakdowns("lineitem"), breakdown_sql("lineitem")),
    "breakdowns_events": (_breakdowns("events"), breakdown_sql("events")),
    "sentences": (sentences_orders, _sentences_sql()),
    "sentences_distribution": (sentences_skewed, _distribution_sql()),
    "insights_report": (insights_report, None),
}
