"""Reading and writing CSV with the missing-value words and column types a data frame user expects."""

from __future__ import annotations

import csv as csv_format
import io

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import as_label, data_type, is_nested, is_number_text, q
from .csv_records import find_records, opens, read_lines
from .order import ROW_ORDER, file_order

# Words read as missing, spellings of a truth value, and accepted file names.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_WORDS = ["True", "TRUE", "true"]
FALSE_WORDS = ["False", "FALSE", "false"]
EXTENSIONS = (".csv", ".csv.gz")
BEYOND = "_beyond"
_QUOTES = {"quote": '"', "escape": '"'}
_SOME_TEXT = r"value RLIKE '[^\\u0000-\\u0020]'"  # lines of blanks are no records
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"


class SourceError(ValueError):
    """The input cannot be read as a table."""


def header_names(line: str) -> list[str]:
    """Column names of a header line; unnamed columns get a number, repeated names ``.1``, ``.2``, ..."""
    names: list[str] = []
    for i, raw in enumerate(next(csv_format.reader(io.StringIO(line.lstrip("﻿").rstrip("\r"), newline="")))):
        base = name = raw or f"Unnamed: {i}"
        repeat = 0
        while name in names:
            repeat += 1
            name = f"{base}.{repeat}"
        names.append(name)
    return names


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Read one CSV file or a folder of them as a typed table with its row order.

    All files must have the same column names in the same order. The column types come from one aggregate over the whole input. Missing cells at
    the end of a row are NULL; a row with a cell beyond the header is an error, and so is a quoted cell that never ends. Files are read
    in as many tasks as they have splits, also if quoted cells hold line breaks; their rows are then written once. ``multi_line=None`` looks
    whether there are any, with the headers, in one pass.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and not name.lower().endswith(EXTENSIONS):
        raise SourceError(f"unsupported file extension of '{name}': expected {', '.join(EXTENSIONS)}")
    lines = read_lines(spark, path)
    torn = F.lit(False) if multi_line is False else F.max(opens(F.col("value")))
    files = lines.filter(_SOME_TEXT).groupBy(f"{ROW_ORDER}.file").agg(F.min_by("value", ROW_ORDER).alias("header"), torn.alias("torn"))
    headers, some_torn = _headers(files)
    if not headers:
        raise SourceError(f"'{name}' is empty")
    if multi_line or some_torn:
        records, unclosed = find_records(lines)
        if unclosed:
            raise SourceError(f"{unclosed} file(s) end inside a quoted cell")
        records = records.filter(_SOME_TEXT)
        firsts = records.groupBy(f"{ROW_ORDER}.file").agg(F.min_by("value", ROW_ORDER).alias("header"), F.min(f"{ROW_ORDER}.row").alias("first"))
        headers, _ = _headers(firsts.withColumn("torn", F.lit(False)))
        names, schema = _layout(headers)
        # A number for each file, so that the records are not shuffled.
        rows = records.join(F.broadcast(firsts.select("first")), F.col(ROW_ORDER)["row"] == F.col("first"), "left_anti")
        line = F.regexp_replace("value", r"\r\z", "")
        parsed = rows.select(F.from_csv(line, ", ".join(f"{c} string" for c in schema.names), _QUOTES).alias("r"), ROW_ORDER).select("r.*", ROW_ORDER)
    else:
        names, schema = _layout(headers)
        parsed = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", **_QUOTES).csv(path).select("*", file_order())
    cells = [c for c in schema.names if c != BEYOND]
    raw = parsed.select(*[F.when(~q(c).isin(MISSING_WORDS), q(c)).alias(c) for c in cells], BEYOND, ROW_ORDER)
    return _with_types(raw, cells).toDF(*names, ROW_ORDER)


def _headers(files: DataFrame) -> tuple[list[str], bool]:
    """A few of the different header lines of files, and whether any file is torn."""
    seen = files.groupBy("header").agg(F.max("torn").alias("torn")).agg(F.slice(F.collect_list("header"), 1, 100), F.max("torn")).first()
    return sorted(seen[0]), bool(seen[1])


def _layout(headers: list[str]) -> tuple[list[str], T.StructType]:
    """Column names, and technical ones to read with: a table scan may not repeat a name, even one that differs only by case."""
    found = {tuple(header_names(h)): h for h in headers}
    if len(found) > 1:
        one, other = sorted(found)[:2]
        raise SourceError(f"files have different headers: {', '.join(one)} and {', '.join(other)}")
    names = list(next(iter(found)))
    return names, T.StructType([T.StructField(c, T.StringType()) for c in [*[f"_c{i}" for i in range(len(names))], BEYOND]])


def _with_types(raw: DataFrame, cells: list[str]) -> DataFrame:
    """Cast every column to the first type all its values fit: long, double, boolean, else string."""
    tests: list[Column] = [F.count(F.lit(1)).alias("rows"), F.count(BEYOND).alias("beyond")]
    for c in cells:
        col = q(c)
        tests += [
            F.count(col).alias(f"n{c}"),
            F.bool_and(col.rlike(WHOLE_NUMBER)).alias(f"w{c}"),
            F.count(F.trim(col).try_cast("long")).alias(f"l{c}"),
            F.bool_and(is_number_text(col)).alias(f"d{c}"),
            F.bool_and(col.isin(TRUE_WORDS + FALSE_WORDS)).alias(f"b{c}"),
        ]
    seen = raw.agg(*tests).first()
    if not seen["rows"]:
        raise SourceError("the input contains no rows")
    if seen["beyond"]:
        raise SourceError(f"{seen['beyond']} row(s) have more cells than the header")

    def typed(c: str) -> Column:
        col, present = q(c), seen[f"n{c}"]
        if present == 0:
            return col.cast("double")
        if seen[f"w{c}"]:
            if seen[f"l{c}"] < present:
                return col  # longer than a long: digits, not a number
            return F.trim(col).cast("long" if present == seen["rows"] else "double")
        if seen[f"d{c}"]:
            return F.trim(col).cast("double")
        return col.isin(TRUE_WORDS) if seen[f"b{c}"] else col

    return raw.select(*[typed(c).alias(c) for c in cells], ROW_ORDER)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a table as CSV with a header; part files follow the row order when there is one."""
    ordered = df.orderBy(ROW_ORDER) if ROW_ORDER in df.columns else df
    plain = ordered.select(*[
        F.to_json(q(c)).alias(c) if is_nested(data_type(df, c)) and not isinstance(data_type(df, c), T.BinaryType)
        else as_label(q(c), data_type(df, c)).alias(c) if isinstance(data_type(df, c), T.BooleanType)
        else q(c)
        for c in df.columns if c != ROW_ORDER
    ])
    stamp = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
    plain.write.mode(mode).options(
        header=True, escape='"', timestampFormat=stamp, timestampNTZFormat=stamp, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
