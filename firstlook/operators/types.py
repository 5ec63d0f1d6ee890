"""What each column means: integer, float, datetime, boolean, categorical or text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import (
    REAL_TYPES, TEXT_TYPES, TIME_TYPES, WHOLE_TYPES, data_type, is_nested, is_number_text, q,
)
from ..functions.dates import may_be_date, parse_datetime

# Fixed values of the type rules.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n", "t", "f", "1", "0"]
BOOLEAN_PATTERN = r"(?iU)^[\s\x1c-\x1f]*(?:" + "|".join(BOOLEAN_WORDS) + r")[\s\x1c-\x1f]*$"
DATE_SHARE = 0.8
CATEGORY_SHARE = 0.5

NUMERIC = ("integer", "float")
CATEGORY = ("categorical", "boolean")

# A distinct sketch is a few percent off; only shares within eight of its deviations are counted exactly.
SKETCH_DEVIATION = 0.05
SKETCH_MARGIN = 8 * SKETCH_DEVIATION
FIRST_ROWS = 100
LONG_TEXT = 64


def distinct_key(col: Column) -> Column:
    """Short stand-in for a text in exact distinct counts: long texts shuffle as their SHA-256.

    A digest is marked and longer than any text kept as is, so the two cannot meet.
    """
    return F.when(F.length(col) <= LONG_TEXT, col).otherwise(F.concat(F.sha2(col, 256), F.lit("#")))


def _is_word(col: Column) -> Column:
    return col.rlike(BOOLEAN_PATTERN)


def _number_kind(col: Column) -> Column:
    """0 for a whole number, 1 for another number, 2 for any other text."""
    whole = F.trim(col).try_cast("double") % 1 == 0
    return F.when(col.isNotNull(), F.when(~is_number_text(col), 2).when(whole, 0).otherwise(1))


def _text_tests(col: Column, word: bool, number: bool) -> dict[str, Column]:
    """Aggregates that settle what a text column holds. All keep fixed-size numbers, never the texts themselves."""
    hashed = F.xxhash64(col)
    return {
        "word": F.bool_and(_is_word(col)) if word else F.lit(False),
        "number": F.max(_number_kind(col)) if number else F.lit(2),
        "dates": F.count_if(may_be_date(col)),
        "many": F.min(hashed) != F.max(hashed),
        "distinct": F.approx_count_distinct(col, SKETCH_DEVIATION),
    }


def _still_possible(df: DataFrame, texts: list[str]) -> dict[str, tuple[bool, bool]]:
    """Which text columns may be all words of truth, or all numbers, after a look at the first rows.

    One counterexample settles either question for good, so most columns skip these tests in the pass
    over the whole table.
    """
    if not texts:
        return {}
    tested = df.select(*[F.struct(_is_word(q(n)).alias("word"), (_number_kind(q(n)) < 2).alias("number")) for n in texts])
    first = tested.head(FIRST_ROWS)
    return {
        n: (all(r[i]["word"] is not False for r in first), all(r[i]["number"] is not False for r in first))
        for i, n in enumerate(texts)
    }


@dataclass(frozen=True)
class Profile:
    rows: int
    nulls: dict[str, int]
    types: dict[str, str]


def infer_types(df: DataFrame) -> dict[str, str]:
    """Semantic type per column."""
    return profile(df).types


def profile(df: DataFrame) -> Profile:
    """Row count, NULL counts and semantic types, from one aggregate over the whole table.

    Two kinds of text columns cost a second look: those whose values start like dates are parsed, and
    those whose distinct share is too close to one half for a sketch are counted exactly.
    """
    types: dict[str, str] = {}
    tests: list[Column] = [F.count(F.lit(1)).alias("rows")]
    possible = _still_possible(df, [f.name for f in df.schema if isinstance(f.dataType, TEXT_TYPES)])
    for i, field in enumerate(df.schema):
        dtype, col = field.dataType, q(field.name)
        if isinstance(dtype, REAL_TYPES):
            col = F.nanvl(col, F.lit(None).cast(dtype))
        tests.append(F.count(col).alias(f"present{i}"))
        if isinstance(dtype, T.BooleanType):
            types[field.name] = "boolean"
        elif isinstance(dtype, TIME_TYPES):
            types[field.name] = "datetime"
        elif isinstance(dtype, WHOLE_TYPES):
            types[field.name] = "integer"
        elif isinstance(dtype, REAL_TYPES + (T.DecimalType,)):
            whole = F.coalesce(col.cast("double") % 1 == 0, F.lit(False))
            tests.append(F.bool_and(F.when(col.isNotNull(), whole)).alias(f"whole{i}"))
        elif isinstance(dtype, TEXT_TYPES):
            tests += [test.alias(f"{name}{i}") for name, test in _text_tests(col, *possible[field.name]).items()]
        else:
            types[field.name] = "text"

    seen = df.agg(*tests).first()
    nulls = {f.name: seen["rows"] - seen[f"present{i}"] for i, f in enumerate(df.schema)}
    present = {f.name: seen[f"present{i}"] for i, f in enumerate(df.schema)}
    open_at = {f.name: i for i, f in enumerate(df.schema) if f.name not in types}
    texts = [n for n in open_at if isinstance(data_type(df, n), TEXT_TYPES) and present[n]]

    maybe_dates = [
        n for n in texts if not seen[f"word{open_at[n]}"] and seen[f"dates{open_at[n]}"] / present[n] >= DATE_SHARE
    ]
    dates = date_shares(df, maybe_dates)
    unsure: list[str] = []
    for name, i in open_at.items():
        if not isinstance(data_type(df, name), TEXT_TYPES):
            types[name] = "integer" if seen[f"whole{i}"] else "float"
        elif not present[name]:
            types[name] = "text"
        elif seen[f"word{i}"]:
            types[name] = "boolean"
        elif dates.get(name, 0.0) >= DATE_SHARE:
            types[name] = "datetime"
        elif seen[f"number{i}"] < 2:
            types[name] = "float" if seen[f"number{i}"] else "integer"
        elif not seen[f"many{i}"]:
            types[name] = "text"
        else:
            share = seen[f"distinct{i}"] / present[name]
            if abs(share / CATEGORY_SHARE - 1) <= SKETCH_MARGIN:
                unsure.append(name)
            types[name] = "categorical" if share < CATEGORY_SHARE else "text"
    for name, (rows, distinct) in exact_distinct(df, unsure).items():
        types[name] = "categorical" if distinct / rows < CATEGORY_SHARE else "text"
    return Profile(seen["rows"], nulls, {f.name: types[f.name] for f in df.schema})


def date_shares(df: DataFrame, names: list[str]) -> dict[str, float]:
    """Share of the non-null values of text columns that are dates."""
    if not names:
        return {}
    row = df.agg(*[(F.count(parse_datetime(q(n))) / F.count(q(n))).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return {n: row[f"c{i}"] for i, n in enumerate(names)}


def exact_distinct(df: DataFrame, names: list[str]) -> dict[str, tuple[int, int]]:
    """Non-null and distinct counts of text columns, all columns in one grouped job."""
    if not names:
        return {}
    keyed = df.select(*[distinct_key(q(n).cast("string")).alias(f"c{i}") for i, n in enumerate(names)])
    long = keyed.unpivot([], list(keyed.columns), "column", "value").where("value is not null")
    counts = (
        long.groupBy("column")
        .agg(F.count("value").alias("rows"), F.count_distinct("value").alias("distinct"))
        .collect()
    )
    found = {names[int(r["column"][1:])]: (r["rows"], r["distinct"]) for r in counts}
    return {n: found.get(n, (0, 0)) for n in names}


def types_table(spark: SparkSession, types: dict[str, str]) -> DataFrame:
    """The types as rows (position, column, semantic_type)."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(types.items())]
    return spark.createDataFrame(rows, "position int, column string, semantic_type string")


def columns_of(types: dict[str, str], *kinds: str) -> list[str]:
    return [name for name, kind in types.items() if kind in kinds]


def groupable(df: DataFrame, types: dict[str, str], *kinds: str) -> list[str]:
    """Columns of the given kinds that hold plain values."""
    return [c for c in columns_of(types, *kinds) if not is_nested(data_type(df, c))]
