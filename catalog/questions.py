"""Samples, previews, descriptions, ad-hoc queries and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from firstlook.operators.adhoc import run_query
from firstlook.operators.describe import column_details, first_values
from firstlook.operators.sample import exact_sample
from firstlook.operators.sessions import parse_replies, prompts, recent_history, system_prompt
from firstlook.sources.records import preview

from .tables import md5_place, read_back, table, union_all

DESCRIPTION = "The table has the columns conv_id, turn, role and text."


def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("line_key", F.xxhash64(F.struct("*")))
    return exact_sample(lines, 5000, "line_key")


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_sample(table(spark, sf_dir, "orders"), 5000, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the records of a preview hold, read back from their JSON."""
    return read_back(preview(table(spark, sf_dir, "events"), "event_id").records)


def sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = exact_sample(table(spark, sf_dir, "events"), 2500, "event_id")
    return picked.agg(F.count("event_id").alias("rows"), F.count_distinct("event_id").alias("distinct_rows"))


def preview_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(table(spark, sf_dir, "events"), "event_id").records


def preview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, key in (("events", "event_id"), ("nation", "n_nationkey")):
        shown = preview(table(spark, sf_dir, name), key)
        rows.append((name, len(shown.columns), shown.total_rows, shown.returned_rows, shown.sampled, shown.records.count()))
    return spark.createDataFrame(
        rows, "table string, columns int, total_rows long, returned_rows long, sampled boolean, records long"
    )


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    kinds = {"p_partkey": "integer", "p_name": "text", "p_brand": "categorical", "p_size": "integer"}
    return column_details(part, kinds, "p_partkey").drop("position")


def profile_first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_values(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name"], "p_partkey")


def _answer(spark: SparkSession, sf_dir: str, sql: str, schema: str) -> DataFrame:
    """A query answered over orders; a single value comes back as one row."""
    found = run_query(table(spark, sf_dir, "orders"), sql).result
    rows = [(found.value,)] if found.type == "scalar" else [tuple(r[c] for c in found.columns) for r in found.records]
    return spark.createDataFrame(rows, schema)


ADHOC = {
    "adhoc_sum": ("SELECT round(sum(o_totalprice), 2) AS total FROM {t}", "total double"),
    "adhoc_groupby": ("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean_price FROM {t} GROUP BY o_orderstatus", "o_orderstatus string, mean_price double"),
    "adhoc_scalar": ("SELECT max(o_totalprice) > 10 * min(o_totalprice) AS wide FROM {t}", "wide boolean"),
    "adhoc_first_thousand": ("SELECT o_orderkey, o_orderstatus FROM {t} ORDER BY o_orderkey DESC LIMIT 1000", "o_orderkey long, o_orderstatus string"),
}


def _adhoc(sql: str, schema: str):
    return lambda spark, sf_dir: _answer(spark, sf_dir, sql.replace("{t}", "{df}"), schema)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session")


def session_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_history(_messages(spark, sf_dir))


def session_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    questions = messages.groupBy("session").agg(F.concat(F.lit("What followed turn "), F.max("turn"), F.lit("?")).alias("question"))
    return prompts(messages, questions, DESCRIPTION).select("session", F.posexplode("messages").alias("position", "m")).select(
        "session", "position", "m.role", "m.content"
    )


def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    text = F.concat(
        F.lit('{"code": "'), "event_type", F.lit('", "answer": '),
        F.when(F.col("event_type") == "click", F.concat(F.lit('"user '), "user_id", F.lit('"'))).otherwise(F.col("user_id").cast("string")),
        F.when(F.col("event_type") == "view", "").otherwise("}"),
    )
    reply = F.when(F.col("event_type") == "purchase", F.concat(F.lit("["), "user_id", F.lit("]"))).otherwise(text)
    return parse_replies(events.select("event_id", reply.alias("reply"))).drop("reply")


def _first_values_sql(columns: list[str], limit: int = 8) -> str:
    return union_all([
        f"""SELECT * FROM (SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY min(p_partkey)) AS INTEGER) AS rank, {c} AS value
        FROM part GROUP BY {c}) WHERE rank <= {limit}""" for c in columns
    ])


_SYSTEM = system_prompt(DESCRIPTION).replace("'", "''")
_RECENT = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations QUALIFY age <= 6)"

QUERIES = {
    "sample_exact": (sample_exact, None),
    "sample_rows": (sample_rows, f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY {md5_place('o_orderkey')}, o_orderkey LIMIT 5000"),
    "preview_rows": (preview_rows, f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value, event_type
        FROM (SELECT * FROM events ORDER BY {md5_place('event_id')}, event_id LIMIT 5000)"""),
    "sample_size": (sample_size, "SELECT least(count(*), 2500) AS rows, least(count(*), 2500) AS distinct_rows FROM events"),
    "preview_records": (preview_records, None),
    "preview_counts": (preview_counts, union_all([
        f"""SELECT '{name}' AS "table", {columns} AS "columns", count(*) AS total_rows, least(count(*), 5000) AS returned_rows,
            count(*) > 5000 AS sampled, least(count(*), 5000) AS records FROM {name}""" for name, columns in (("events", 6), ("nation", 3))
    ])),
    "profile_columns": (profile_columns, f"""
        SELECT 'p_partkey' AS "column", 'integer' AS semantic_type, min(CAST(p_partkey AS DOUBLE)) || '..' || max(CAST(p_partkey AS DOUBLE)) AS detail FROM part
        UNION ALL SELECT 'p_size', 'integer', min(CAST(p_size AS DOUBLE)) || '..' || max(CAST(p_size AS DOUBLE)) FROM part
        UNION ALL SELECT 'p_name', 'text', arg_min(p_name, p_partkey) FROM part
        UNION ALL SELECT 'p_brand', 'categorical', CAST(to_json(list(value ORDER BY rank)) AS VARCHAR) FROM ({_first_values_sql(['p_brand'])})"""),
    "profile_first_values": (profile_first_values, _first_values_sql(["p_brand", "p_type", "p_name"])),
    **{name: (_adhoc(sql, schema), sql.replace("{t}", "orders")) for name, (sql, schema) in ADHOC.items()},
    "session_recent": (session_recent, f"SELECT conv_id AS session, turn, role, text FROM {_RECENT}"),
    "session_prompt": (session_prompt, f"""
        WITH recent AS {_RECENT}, ends AS (SELECT conv_id, max(turn) AS last, count(*) AS n FROM recent GROUP BY conv_id)
        SELECT conv_id AS session, 0 AS position, 'system' AS role, '{_SYSTEM}' AS content FROM ends
        UNION ALL SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER), role, text FROM recent
        UNION ALL SELECT conv_id, CAST(n + 1 AS INTEGER), 'user', 'What followed turn ' || last || '?' FROM ends"""),
    "reply_parse": (reply_parse, """
        SELECT event_id, CASE WHEN event_type IN ('purchase', 'view') THEN '' ELSE event_type END AS code,
            CASE WHEN event_type = 'click' THEN 'user ' || user_id ELSE '' END AS answer,
            CASE WHEN event_type = 'purchase' THEN 'reply is not a JSON object' WHEN event_type = 'view' THEN 'reply is not valid JSON' END AS error
        FROM events"""),
}
