"""Names, trimming, number text and dates, against Python and pandas."""

import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from firstlook.functions.columns import as_number, is_number_text, nan_to_null
from firstlook.functions.dates import elapsed_days, iso_text, parse_datetime, period_label
from firstlook.functions.text import snake_case, snake_names, trim_space


@pytest.mark.parametrize("name, expected", [
    ("Guest  Name", "guest_name"), ("roomID", "room_id"), ("NetPrice", "net_price"),
    (" -late.fee- ", "late_fee"), ("Height [cm]", "height_cm"), ("HTTPServer2Go", "httpserver2_go"),
    ("Größe", "gr_e"), ("!!", "column"), ("", "column"), ("a1B", "a1_b"),
])
def test_snake_case(name, expected):
    assert snake_case(name) == expected


def test_repeated_names_are_numbered():
    assert snake_names(["Fee", "fee", "x", "FEE"]) == ["fee", "fee_1", "x", "fee_2"]
    assert snake_names(["a", "a.1", "A"]) == ["a", "a_1", "a_2"]
    assert snake_names(["?", "!", "a", "A "]) == ["column", "column_1", "a", "a_1"]


def test_trim_space_matches_python(spark):
    texts = ["  a b ", "\tx\n", "  y  ", "\x1cz\x1f", "plain", "", " ", "a\n\nb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(trim_space(F.col("t"))).collect()
    assert [r[0] for r in rows] == [t.strip() for t in texts]


def test_number_text(spark):
    good = ["1", "-2.5", "+3", "1e5", ".5", "5.", " 7 ", "inf", "-Infinity"]
    bad = ["", "1d", "5f", "1_000", "abc", "1,5", "0x1F", "--1", "e5", "."]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select(is_number_text(F.col("t"))).collect()
    assert [r[0] for r in rows] == [True] * len(good) + [False] * len(bad)


def test_as_number_and_nan(spark):
    df = spark.createDataFrame([("1.5", float("nan")), ("x", 2.0)], "s string, d double")
    got = nan_to_null(df).select(as_number(F.col("s"), df.schema["s"].dataType), "d").collect()
    assert [tuple(r) for r in got] == [(1.5, None), (None, 2.0)]


DATES = [
    "2024-01-05", "2024-1-5", "2024/01/05", "20240105", "2024-01-05 10:11", "2024-01-05T10:11:12", "2024-01-05T10:11:12Z",
    "2024-01-05 10:11:12.5", "2024-01-05T10", "5/6/2024", "25/12/2024", "13/13/2024", "5-6-2024", "25.12.2024", "05-Jan-2024",
    "5 Jan 2024", "05Jan2024", "Jan 5, 2024", "January 5, 2024", "May 2024", "2024-05", "05/2024", "2024-Q1", "2024Q3", "Q1 2024",
    "2020", "62", "1234", "12345678", "1/2", "Monday", "NYC", "1-URGENT", "1.5", "100", "2024.5", "1/2/24", "2024-01-05 10:11:12 PM",
    "1/5/2024 3:04 PM", "2024-13-01", "2024-02-30", "0001-01-01", "9999-12-31", "20240105T101112", "20240105101112", "1704067200",
    "Fri, 05 Jan 2024 10:11:12", "2024 Jan 5", "Sept 5 2024", "5th January 2024", " 2024-01-05 ", "2024-01-05 24:00", "not-a-date",
    "abc 2024", "", "2024-01-05 12:00 AM", "1/1/1700", "1677-01-01",
]


def test_dates_match_pandas(spark):
    df = spark.createDataFrame([(t,) for t in DATES], "t string")
    got = {r[0]: r[1] for r in df.select("t", parse_datetime(F.col("t"))).collect()}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for text in DATES:
            parsed = pd.to_datetime(pd.Series([text], dtype=object), errors="coerce", format="mixed").iloc[0]
            expected = None if pd.isna(parsed) else parsed.tz_localize(None).to_pydatetime()
            assert got[text] == expected, text


def test_elapsed_days_are_whole_days_of_time(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 23:30:00' a, timestamp_ntz'2024-01-02 23:00:00' z")
    assert df.select(elapsed_days(F.col("a"), F.col("z"))).first()[0] == 0


def test_iso_text_and_labels(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-12-30 01:02:03' a, timestamp_ntz'2024-03-05 01:02:03.5' b")
    row = df.select(
        iso_text(F.col("a")), iso_text(F.col("b")), period_label(F.col("a"), "week"),
        period_label(F.col("a"), "quarter"), period_label(F.col("b"), "month"),
    ).first()
    assert tuple(row) == ("2024-12-30T01:02:03", "2024-03-05T01:02:03.500000", "2025-W01", "2024-Q4", "2024-03")
