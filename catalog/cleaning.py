"""Sources, cleaning and type inference."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from firstlook.operators.clean import (
    clean, drop_duplicates, drop_sparse, fill_missing, null_profile, rename_columns, trim_cells,
)
from firstlook.operators.stats import overview
from firstlook.operators.types import infer_types, types_table
from firstlook.plans.written import shared_folder
from firstlook.sources.csv import MISSING_WORDS, SourceError, read_csv, write_csv
from firstlook.sources.datasets import Datasets, write_report
from firstlook.sources.order import ROW_ORDER
from firstlook.sources.records import records

from .tables import faulty_orders, faulty_sql, read_back, rounded, table, union_all

FAULTY = f"WITH faulty AS ({faulty_sql('duckdb')})"
MISSING = "(" + ", ".join(f"'{w}'" for w in MISSING_WORDS) + ")"
BOOLEAN_WORDS = "('true','false','yes','no','y','n','t','f','1','0')"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    write_csv(table(spark, sf_dir, "part"), path)
    return read_csv(spark, path).drop(ROW_ORDER)


def dataset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Datasets(spark, _scratch(spark))
    return kept.get(kept.create(table(spark, sf_dir, "customer"), "customer"))


def records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").drop("value")
    return records(events.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz")))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as JSON and read back."""
    path = _scratch(spark)
    write_report(null_profile(table(spark, sf_dir, "lineitem")), path)
    return spark.read.schema("column string, nulls long, null_ratio double").json(path)


def records_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and times as records hold them, with NaN and infinite numbers among them."""
    odd = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 1, F.lit(float("-inf")))
    return read_back(records(table(spark, sf_dir, "events").withColumn("value", odd.otherwise(F.col("value")))))


def clean_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    padded = F.concat(F.lit(" \t"), F.col("o_orderpriority"), F.lit("  \n"))
    return trim_cells(orders.select("o_orderkey", padded.alias("priority")))


def clean_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"o_orderkey": "Order Key", "o_custkey": "orderKey", "o_totalprice": "  Total-Price (USD) "}
    messy = table(spark, sf_dir, "orders").select(*[F.col(c).alias(n) for c, n in names.items()])
    return rename_columns(messy)[0]


def clean_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(ROW_ORDER), "text", "lang")
    return drop_duplicates(documents).select(F.col(ROW_ORDER).alias("first_doc"), "lang", F.length("text").alias("chars"))


def clean_dedupe_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return drop_duplicates(lines)


def clean_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(null_profile(faulty_orders(spark, sf_dir)))


def clean_drop_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_sparse(faulty_orders(spark, sf_dir))


def _filled(spark: SparkSession, sf_dir: str, column: str, kind: str) -> DataFrame:
    part = faulty_orders(spark, sf_dir).select("row_no", column)
    return fill_missing(part, {"row_no": "integer", column: kind}).table


def clean_fill_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_filled(spark, sf_dir, "total_price", "float"))


def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading says about nation lines of which those of even keys have a cell too many."""
    path = _scratch(spark)
    line = F.concat_ws(",", "n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lit("extra")))
    header = spark.range(1).select(F.lit("n_nationkey,n_name").alias("value"))
    header.union(table(spark, sf_dir, "nation").select(line)).coalesce(1).write.text(path)
    try:
        read_csv(spark, path)
        said = "read"
    except SourceError as reason:
        said = str(reason)
    return spark.createDataFrame([(said,)], "said string")


def csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks, written as CSV and read back in many splits for each file."""
    path = _scratch(spark)
    write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path)
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, str(256 * 1024))
    try:
        return read_csv(spark, path).drop(ROW_ORDER)
    finally:
        spark.conf.set(key, before)


def _what_reading_says(spark: SparkSession, path: str) -> str:
    try:
        return f"{len(read_csv(spark, path).columns) - 1} columns"
    except SourceError as reason:
        return str(reason)


def csv_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading says about folders of nations: as they should be, with two headers, header only, empty, unclosed, and under a wrong name."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    swapped = table(spark, sf_dir, "region").select(F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_nationkey"))
    lines = spark.range(1).select(F.lit("n_nationkey,n_name").alias("value"))
    said = []
    for case, parts in {
        "as it should be": [nations, nations.filter("n_nationkey > 3")], "two headers": [nations, swapped], "header only": [lines],
        "empty": [lines.limit(0)], "unclosed": [lines.union(nations.select(F.format_string('%d,"%s', "n_nationkey", "n_name")).limit(1))],
    }.items():
        path = _scratch(spark)
        for part in parts:
            if part.columns == ["value"]:
                part.coalesce(1).write.text(path)
            else:
                part.write.mode("append").csv(path, header=True)
        said.append((case, _what_reading_says(spark, path).replace(path.rsplit("/", 1)[-1], "folder")))
    said.append(("wrong name", _what_reading_says(spark, _scratch(spark) + ".xlsx").split(" of ")[0]))
    return spark.createDataFrame(said, "source string, said string")


def clean_ffill_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates filled in the order of a column that is itself data and has a fill rule of its own."""
    gaps = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")).alias("o_orderdate")
    )
    filled = fill_missing(gaps, {"o_orderkey": "integer", "o_orderdate": "datetime"}, order_by="o_orderkey").table
    return filled.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


def clean_fill_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, "order_status", "categorical")


def clean_fill_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, "note", "text")


def clean_ffill_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "events").select(
        "event_id", F.when(~F.col("event_type").isin("click", "error"), F.col("ts")).alias("ts")
    )
    filled = fill_missing(gaps, {"event_id": "integer", "ts": "datetime"}, order_by="event_id").table
    return filled.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


def _ordered_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faulty_orders(spark, sf_dir).withColumnRenamed("row_no", ROW_ORDER)


def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean(_ordered_faults(spark, sf_dir)).table.withColumnRenamed(ROW_ORDER, "row_no")
    return rounded(cleaned.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd")))


def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = clean(_ordered_faults(spark, sf_dir)).report
    counters = F.struct(*[
        F.lit(getattr(report, c)).cast("long").alias(c) for c in ("rows_in", "rows_out", "cols_in", "cols_out", "duplicates_removed")
    ])
    return report.columns_table(spark).select(
        "name", "detected_type", "nulls_before", "nulls_after", "coerced_to_null",
        F.when(F.col("action").startswith("filled with median"), "filled with median").otherwise(F.col("action")).alias("action"),
        F.inline(F.array(counters)),
    )


def infer_types_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for name in INFERRED:
        kinds = types_table(spark, infer_types(table(spark, sf_dir, name))).select(F.lit(name).alias("table"), "column", "semantic_type")
        found = kinds if found is None else found.unionByName(kinds)
    return found


def infer_text_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    texts = orders.select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.format_string("%.2f", "o_totalprice").alias("price"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("us_date"),
        F.date_format("o_orderdate", "dd-MMM-yyyy").alias("named_date"),
        F.when(F.col("o_orderstatus") == "F", " Yes").otherwise("no").alias("finished"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"),
        F.col("o_orderpriority").alias("priority"),
    )
    return types_table(spark, infer_types(texts)).select("column", "semantic_type")


def overview_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview(table(spark, sf_dir, "lineitem"))


# Column kinds as stored; text columns are decided by SQL.
INFERRED = {
    "customer": {"c_custkey": "whole", "c_name": "text", "c_nationkey": "whole", "c_acctbal": "real", "c_mktsegment": "text"},
    "part": {"p_partkey": "whole", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "whole", "p_retailprice": "real"},
    "orders": {"o_orderkey": "whole", "o_custkey": "whole", "o_orderstatus": "text", "o_totalprice": "real", "o_orderdate": "time", "o_orderpriority": "text"},
    "lineitem": {
        "l_orderkey": "whole", "l_partkey": "whole", "l_suppkey": "whole", "l_linenumber": "whole", "l_quantity": "real",
        "l_extendedprice": "real", "l_discount": "real", "l_tax": "real", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time",
    },
    "events": {"event_id": "whole", "ts": "time", "user_id": "whole", "event_type": "text", "value": "real", "props": "text"},
    "documents": {"doc_id": "whole", "text": "text", "lang": "text", "source": "text", "n_chars": "whole"},
}


def type_sql(column: str, stored: str, dates: str | None = None) -> str:
    """SQL for the semantic type of one column, as an aggregate."""
    if stored == "whole":
        return "max('integer')"
    if stored == "time":
        return "max('datetime')"
    if stored == "real":
        return f"CASE WHEN bool_and({column} = floor({column})) THEN 'integer' ELSE 'float' END"
    parsed = dates or f"try_cast({column} AS TIMESTAMP)"
    number = f"try_cast({column} AS DOUBLE)"
    return f"""CASE WHEN bool_and(lower(trim({column})) IN {BOOLEAN_WORDS}) THEN 'boolean'
        WHEN count({parsed}) >= 0.8 * count({column}) THEN 'datetime'
        WHEN count({number}) = count({column}) AND bool_and({number} = floor({number})) THEN 'integer'
        WHEN count({number}) = count({column}) THEN 'float'
        WHEN count(DISTINCT {column}) >= 2 AND count(DISTINCT {column}) < 0.5 * count({column}) THEN 'categorical'
        ELSE 'text' END"""


def _infer_sql() -> str:
    return union_all([
        f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", {type_sql(c, stored)} AS semantic_type FROM {name}"
        for name, columns in INFERRED.items() for c, stored in columns.items()
    ])


def _text_types_sql() -> str:
    columns = {
        "key": ("CAST(o_orderkey AS VARCHAR)", "CASE WHEN length(key) = 4 AND key BETWEEN '1680' AND '2261' THEN 1 END"),
        "price": ("printf('%.2f', o_totalprice)", "CASE WHEN length(price) = 7 AND price BETWEEN '1680' AND '2262' THEN 1 END"),
        "us_date": ("strftime(o_orderdate, '%-m/%-d/%Y')", "try_strptime(us_date, '%m/%d/%Y')"),
        "named_date": ("strftime(o_orderdate, '%d-%b-%Y')", "try_strptime(named_date, '%d-%b-%Y')"),
        "finished": ("CASE WHEN o_orderstatus = 'F' THEN ' Yes' ELSE 'no' END", None),
        "title": ("'order ' || o_orderkey", None),
        "priority": ("o_orderpriority", None),
    }
    view = ", ".join(f"{sql} AS {c}" for c, (sql, _) in columns.items())
    parts = [f"SELECT '{c}' AS \"column\", {type_sql(c, 'text', dates)} AS semantic_type FROM texts" for c, (_, dates) in columns.items()]
    return f"WITH texts AS (SELECT {view} FROM orders)\n" + union_all(parts)


_COLUMNS = ["order_priority", "order_status", "total_price", "mostly_empty", "order_date", "note"]
_FIRSTS = f"""{FAULTY},
firsts AS (
    SELECT min(row_no) AS row_no, trim(order_priority) AS order_priority, order_status, total_price, mostly_empty, order_date, note
    FROM faulty GROUP BY ALL
),
dated AS (SELECT *, try_strptime(order_date, '%Y-%m-%d') AS parsed FROM firsts),
mode_of AS (SELECT order_status AS top FROM firsts WHERE order_status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
_FFILL = """coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY {o} ROWS UNBOUNDED PRECEDING),
    first_value({c} IGNORE NULLS) OVER (ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""

_GAPS = "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS d FROM orders"

QUERIES = {
    "csv_ragged": (csv_ragged, "SELECT count(*) || ' row(s) have more cells than the header' AS said FROM nation WHERE n_nationkey % 2 = 0"),
    "csv_quoted": (csv_quoted, f"SELECT doc_id, CASE WHEN text NOT IN {MISSING} THEN text END AS text, lang, source FROM documents"),
    "csv_guards": (csv_guards, """SELECT unnest(['as it should be', 'two headers', 'header only', 'empty', 'unclosed', 'wrong name']) AS source,
        unnest(['2 columns', 'files have different headers: n_name, n_nationkey and n_nationkey, n_name', 'the input contains no rows', '''folder'' is empty',
            '1 file(s) end inside a quoted cell', 'unsupported file extension']) AS said"""),
    "clean_ffill_by_number": (
        clean_ffill_by_number,
        f"SELECT o_orderkey, strftime({_FFILL.format(c='d', o='o_orderkey')}, '%Y-%m-%d') AS o_orderdate FROM ({_GAPS})",
    ),
    "csv_roundtrip": (csv_roundtrip, "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"),
    "dataset_roundtrip": (dataset_roundtrip, "SELECT * FROM customer"),
    "records_json": (records_json, """
        SELECT '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","user_id":' || user_id
            || ',"event_type":"' || event_type || '","props":' || to_json(props) || '}' AS record FROM events"""),
    "report_json": (report_json, """SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice',
        'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']) AS "column", 0::BIGINT AS nulls, 0::DOUBLE AS null_ratio"""),
    "records_values": (records_values, """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
        CASE WHEN event_id % 7 > 1 THEN value END AS value, event_type FROM events"""),
    "clean_trim": (clean_trim, "SELECT o_orderkey, trim(' ' || chr(9) || o_orderpriority || chr(160) || ' ' || chr(10), ' ' || chr(9) || chr(10) || chr(160)) AS priority FROM orders"),
    "clean_rename": (clean_rename, "SELECT o_orderkey AS order_key, o_custkey AS order_key_1, o_totalprice AS total_price_usd FROM orders"),
    "clean_dedupe": (clean_dedupe, "SELECT min(doc_id) AS first_doc, lang, CAST(length(text) AS INTEGER) AS chars FROM documents GROUP BY text, lang"),
    "clean_dedupe_hot": (clean_dedupe_hot, "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem"),
    "clean_null_profile": (clean_null_profile, FAULTY + union_all([
        f"\nSELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*), 6) AS null_ratio FROM faulty"
        for c in ["row_no", *_COLUMNS]
    ])),
    "clean_drop_sparse": (clean_drop_sparse, FAULTY + " SELECT * EXCLUDE (mostly_empty) FROM faulty"),
    "clean_fill_median": (clean_fill_median, FAULTY + """
        SELECT row_no, round(coalesce(total_price, (SELECT quantile_cont(total_price, 0.5) FROM faulty)), 6) AS total_price FROM faulty"""),
    "clean_fill_mode": (clean_fill_mode, FAULTY + """
        SELECT row_no, coalesce(order_status, (SELECT order_status FROM faulty WHERE order_status IS NOT NULL
            GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS order_status FROM faulty"""),
    "clean_fill_text": (clean_fill_text, FAULTY + " SELECT row_no, coalesce(note, 'unknown') AS note FROM faulty"),
    "clean_ffill_datetime": (clean_ffill_datetime, f"""
        WITH gaps AS (SELECT event_id, CASE WHEN event_type NOT IN ('click', 'error') THEN ts END AS ts FROM events)
        SELECT event_id, strftime({_FFILL.format(c='ts', o='event_id')}, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM gaps"""),
    "clean_table": (clean_table, f"""{_FIRSTS}
        SELECT row_no, order_priority, coalesce(order_status, (SELECT top FROM mode_of)) AS order_status,
            round(coalesce(total_price, (SELECT quantile_cont(total_price, 0.5) FROM firsts)), 6) AS total_price,
            strftime({_FFILL.format(c='parsed', o='row_no')}, '%Y-%m-%d') AS order_date,
            coalesce(note, 'unknown') AS note
        FROM dated"""),
    "clean_report": (clean_report, f"""{_FIRSTS},
        counters AS (SELECT (SELECT count(*) FROM faulty) AS rows_in, (SELECT count(*) FROM firsts) AS rows_out,
            CAST(6 AS BIGINT) AS cols_in, CAST(5 AS BIGINT) AS cols_out, (SELECT count(*) FROM faulty) - (SELECT count(*) FROM firsts) AS duplicates_removed),
        cols AS (
            SELECT 'order_priority' AS name, 'categorical' AS detected_type, count(*) - count(order_priority) AS nulls_before, 0 AS coerced,
                'filled with mode (''' || (SELECT order_priority FROM firsts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) || ''')' AS action FROM dated
            UNION ALL SELECT 'order_status', 'categorical', count(*) - count(order_status), 0, 'filled with mode (''' || (SELECT top FROM mode_of) || ''')' FROM dated
            UNION ALL SELECT 'total_price', 'float', count(*) - count(total_price), 0, 'filled with median' FROM dated
            UNION ALL SELECT 'mostly_empty', 'integer', count(*) - count(mostly_empty), 0,
                'dropped (' || CAST(round(100.0 * (count(*) - count(mostly_empty)) / count(*)) AS INTEGER) || '% null)' FROM dated
            UNION ALL SELECT 'order_date', 'datetime', count(*) - count(order_date), count(order_date) - count(parsed), 'forward-filled (with backfill fallback)' FROM dated
            UNION ALL SELECT 'note', 'text', count(*) - count(note), 0, 'filled with constant ''unknown''' FROM dated)
        SELECT name, detected_type, nulls_before, CAST(0 AS BIGINT) AS nulls_after, CAST(coerced AS BIGINT) AS coerced_to_null, action,
            rows_in, rows_out, cols_in, cols_out, duplicates_removed FROM cols, counters"""),
    "infer_types": (infer_types_all, _infer_sql()),
    "infer_text_types": (infer_text_types, _text_types_sql()),
    "overview_by_type": (overview_by_type, "WITH kinds AS (" + union_all([
        f"SELECT {type_sql(c, stored)} AS semantic_type FROM lineitem" for c, stored in INFERRED["lineitem"].items()
    ]) + """) SELECT (SELECT count(*) FROM lineitem) AS rows, CAST(11 AS BIGINT) AS cols, semantic_type, count(*) AS "columns" FROM kinds GROUP BY semantic_type"""),
}
