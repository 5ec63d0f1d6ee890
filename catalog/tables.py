"""Loading tables, rounding results and building the SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema
    ])


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# The orders table with the faults a cleaning run has to deal with: padded cells, missing values, bad
# dates, a mostly empty column, and every row twice. The same text runs in Spark and in DuckDB.
_FAULTY_COLUMNS = """
    concat('  ', o_orderpriority, ' ') AS order_priority,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END AS order_status,
    CASE WHEN o_totalprice > 450000 THEN NULL ELSE o_totalprice END AS total_price,
    CASE WHEN o_orderstatus = 'P' THEN o_custkey END AS mostly_empty,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'not-a-date'
         WHEN o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM' THEN NULL
         ELSE {day} END AS order_date,
    CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN NULL ELSE concat('note ', o_orderkey) END AS note
"""
COPY_OFFSET = 1_000_000_000_000


def faulty_sql(engine: str) -> str:
    """Faulty orders with a row number ``row_no``; the second copy of every row comes after all first ones."""
    day = {"spark": "date_format(o_orderdate, 'yyyy-MM-dd')", "duckdb": "strftime(o_orderdate, '%Y-%m-%d')"}[engine]
    columns = _FAULTY_COLUMNS.format(day=day)
    return union_all([f"SELECT o_orderkey + {offset} AS row_no, {columns} FROM orders" for offset in (0, COPY_OFFSET)])


def faulty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return spark.sql(faulty_sql("spark").replace("FROM orders", "FROM {orders}"), orders=orders)


def md5_place(key: str, seed: int = 42) -> str:
    """In SQL, the position that samples and splits give a row: 15 hex digits of an MD5, which sort as the number does."""
    return f"substr(md5('{seed}|' || {key}), 1, 15)"


def read_back(lines: DataFrame) -> DataFrame:
    """Event records as columns again, times with microseconds."""
    cells = F.from_json("record", "event_id long, ts string, value double, event_type string")
    stamp = F.date_format(F.col("r.ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return lines.select(cells.alias("r")).select("r.event_id", stamp.alias("ts"), "r.value", "r.event_type")
