"""Types, cleaning and its report, against values worked out with pandas."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from firstlook.operators.clean import (
    clean, drop_duplicates, drop_sparse, fill_missing, null_profile, rename_columns, trim_cells,
)
from firstlook.operators.types import infer_types, profile
from firstlook.sources.order import ROW_ORDER
from firstlook.sources.records import records


def kinds(spark, values, schema):
    return infer_types(spark.createDataFrame([(v,) for v in values], f"c {schema}"))["c"]


@pytest.mark.parametrize("values, schema, expected", [
    ([1, 2, 3], "long", "integer"),
    ([1.5, 2.0], "double", "float"),
    ([1.0, 2.0, None], "double", "integer"),
    ([float("nan"), 2.0], "double", "integer"),
    ([None, None], "double", "float"),
    ([float("inf"), 2.0], "double", "float"),
    ([True, None], "boolean", "boolean"),
    (["Yes", " no", None], "string", "boolean"),
    (["1", "0", "1"], "string", "boolean"),
    (["2024-01-01", "2024-02-01", "x", "2024-03-01", "2024-04-01"], "string", "datetime"),
    (["2024-01-01", "x", "2024-03-01", "y"], "string", "text"),
    (["2020", "2021", "2022"], "string", "datetime"),
    (["10", "20", "31"], "string", "integer"),
    (["10", None, "31"], "string", "integer"),
    ([None] * 150 + ["10", "3.5"], "string", "float"),
    (["7"] * 150 + ["x"], "string", "categorical"),
    (["yes"] * 150 + ["maybe"], "string", "categorical"),
    (["1.5", "20"], "string", "float"),
    (["a", "a", "a", "b", "b"], "string", "categorical"),
    (["a", "a", "b", "b"], "string", "text"),
    (["a", "a", "a"], "string", "text"),
    ([None, None], "string", "text"),
    ([f"ticket-{i} for hall" for i in range(60)], "string", "text"),
    ([dt.date(2024, 1, 1)], "date", "datetime"),
    ([[1, 2]], "array<int>", "text"),
    ([], "long", "integer"), ([], "double", "float"), ([], "string", "text"),
])
def test_types(spark, values, schema, expected):
    assert kinds(spark, values, schema) == expected


def test_distinct_share_near_one_half_is_counted_exactly(spark):
    below = spark.range(20_000).select(F.concat(F.lit("v"), (F.col("id") % 9_999)).alias("c"))
    at = spark.range(20_000).select(F.concat(F.lit("v"), (F.col("id") % 10_000)).alias("c"))
    assert infer_types(below) == {"c": "categorical"} and infer_types(at) == {"c": "text"}


def test_long_texts_differ_by_their_end(spark):
    df = spark.range(40).select(F.concat(F.repeat(F.lit("x"), 200), F.col("id") % 20).alias("c"))
    assert infer_types(df) == {"c": "text"}
    assert infer_types(df.withColumn("c", F.concat(F.repeat(F.lit("x"), 200), F.substring("c", 201, 1)))) == {"c": "categorical"}


def test_profile_counts_nan_as_missing(spark):
    found = profile(spark.createDataFrame([(1.0, "a"), (float("nan"), None)], "d double, s string"))
    assert found.rows == 2 and found.nulls == {"d": 1, "s": 1}


def test_trim_leaves_other_types(spark):
    df = spark.createDataFrame([(" a ", 1, None)], "s string, n int, d double")
    assert tuple(trim_cells(df).first()) == ("a", 1, None)


def test_rename_reports_every_column(spark):
    df, renames = rename_columns(spark.createDataFrame([(1, 2)], "`Guest Name` int, roomID int"))
    assert df.columns == ["guest_name", "room_id"]
    assert renames == {"Guest Name": "guest_name", "roomID": "room_id"}


def test_duplicates_keep_the_first_row(spark):
    df = spark.createDataFrame([(5, "a", None), (3, "a", None), (9, "b", 1.0)], f"{ROW_ORDER} long, s string, d double")
    assert sorted(tuple(r) for r in drop_duplicates(df).collect()) == [(3, "a", None), (9, "b", 1.0)]
    assert drop_duplicates(df.drop(ROW_ORDER)).count() == 2


def test_sparse_limit_is_strict(spark):
    df = spark.createDataFrame([(i, None if i < 6 else 1, None if i < 7 else 1) for i in range(10)], "a int, b int, c int")
    assert {r["column"]: r["null_ratio"] for r in null_profile(df).collect()} == {"a": 0.0, "b": 0.6, "c": 0.7}
    assert drop_sparse(df).columns == ["a", "b"]


def filled(spark, rows, schema, types, order_by=None):
    return fill_missing(spark.createDataFrame(rows, schema), types, order_by=order_by)


def test_numbers_take_the_median(spark):
    got = filled(spark, [(1, 2.0, "5"), (2, None, None), (3, 9.0, "8"), (4, 40.0, "11")], "k int, d double, s string",
                 {"k": "integer", "d": "float", "s": "integer"})
    assert [r["d"] for r in got.table.orderBy("k").collect()] == [2.0, 9.0, 9.0, 40.0]
    assert [r["s"] for r in got.table.orderBy("k").collect()] == [5.0, 8.0, 8.0, 11.0]
    assert got.actions["d"] == "filled with median (9.0)" and got.dropped == []


def test_a_fractional_median_turns_whole_numbers_into_doubles(spark):
    got = filled(spark, [(1,), (3,), (None,), (7,)], "n long", {"n": "integer"})
    assert got.table.dtypes == [("n", "bigint")] and sorted(r[0] for r in got.table.collect()) == [1, 3, 3, 7]
    got = filled(spark, [(1,), (2,), (None,)], "n long", {"n": "integer"})
    assert sorted(r[0] for r in got.table.collect()) == [1.0, 1.5, 2.0]


def test_categories_take_the_smallest_mode(spark):
    got = filled(spark, [("b",), ("a",), (None,), ("b",), ("a",)], "c string", {"c": "categorical"})
    assert sorted(r[0] for r in got.table.collect()) == ["a", "a", "a", "b", "b"]
    assert got.actions["c"] == "filled with mode ('a')"
    got = filled(spark, [(True,), (None,), (False,), (True,)], "c boolean", {"c": "boolean"})
    assert sorted(r[0] for r in got.table.collect()) == [False, True, True, True]
    assert got.actions["c"] == "filled with mode ('True')"


def test_texts_take_a_constant_and_empty_columns_do_not_fail(spark):
    got = filled(spark, [("late",), (None,), ("wet",)], "c string", {"c": "text"})
    assert sorted(r[0] for r in got.table.collect()) == ["late", "unknown", "wet"]
    empty = filled(spark, [], "n double, c string", {"n": "float", "c": "categorical"})
    assert empty.actions == {"n": "left empty (no non-null values to compute median)", "c": "filled with constant 'unknown'"}


def test_dates_are_filled_in_row_order(spark):
    rows = [(1, None), (2, "2024-01-01"), (3, "bad"), (4, "3/1/2024"), (5, None), (6, "2024-04-01"), (7, "2024-05-01"), (8, "2024-06-01")]
    got = filled(spark, rows, "k int, d string", {"k": "integer", "d": "datetime"}, order_by="k")
    days = [r["d"].strftime("%m-%d") for r in got.table.orderBy("k").collect()]
    assert days == ["01-01", "01-01", "01-01", "03-01", "03-01", "04-01", "05-01", "06-01"]
    assert got.coerced_to_null == {"d": 1}
    with pytest.raises(ValueError, match="row order"):
        filled(spark, rows, "k int, d string", {"k": "integer", "d": "datetime"})


def test_nested_columns_pass_through(spark):
    got = clean(spark.createDataFrame([([1], 1.0), (None, None), ([2], 3.0)], "a array<int>, n double"))
    assert got.report.columns[0].action.startswith("left as is") and got.report.columns[0].nulls_after == 1
    assert sorted(r["n"] for r in got.table.collect()) == [1.0, 2.0, 3.0]


def test_whole_run(cleaned, parcels):
    report = cleaned.report
    assert (report.rows_in, report.rows_out, report.duplicates_removed) == (257, 240, 17)
    assert report.dropped_columns == ["scratch_1", "scratch_2"] and (report.cols_in, report.cols_out) == (9, 7)
    names = dict(zip(["sent_on", "weight_kg", "depot", "express", "label", "pieces", "parcel_no"],
                     ["Sent On", "weightKg", "Depot", "Express?", "Label", "Pieces", "Parcel No"]))
    assert {new: old for old, new in report.renamed_columns.items() if new in names} == names
    kinds = {c.name: c.detected_type for c in report.columns}
    assert [kinds[n] for n in names] == ["datetime", "float", "categorical", "boolean", "text", "integer", "integer"]
    assert {c.name: c.nulls_before for c in report.columns if c.name in names} == {n: parcels[o].isna().sum() for n, o in names.items()}
    assert all(c.nulls_after == 0 for c in report.columns if c.name in names)

    dates = pd.to_datetime(parcels["Sent On"], format="%Y-%m-%d", errors="coerce")
    lost = next(c.coerced_to_null for c in report.columns if c.name == "sent_on")
    assert lost == dates.isna().sum() - parcels["Sent On"].isna().sum() > 0
    want = pd.DataFrame({
        "sent_on": dates.ffill().bfill(), "weight_kg": parcels["weightKg"].fillna(parcels["weightKg"].median()),
        "depot": parcels["Depot"].fillna(parcels["Depot"].mode()[0]),
        "express": parcels["Express?"].fillna(parcels["Express?"].mode()[0]).astype(str).str.lower(),
        "label": parcels["Label"].fillna("unknown"), "pieces": parcels["Pieces"].fillna(parcels["Pieces"].median()).astype(float),
        "parcel_no": parcels["Parcel No"],
    })
    got = cleaned.table.drop(ROW_ORDER).toPandas().sort_values("parcel_no")
    got["express"], got["pieces"] = got["express"].astype(str).str.lower(), got["pieces"].astype(float)
    assert got[list(want)].astype(str).values.tolist() == want.sort_values("parcel_no").astype(str).values.tolist()


def test_report_tables(spark, cleaned):
    summary = cleaned.report.summary_table(spark).first()
    assert summary["rows_out"] == 240 and summary["renamed_columns"]["weightKg"] == "weight_kg"
    actions = {r["name"]: r["action"] for r in cleaned.report.columns_table(spark).collect()}
    assert actions["scratch_1"] == "dropped (100% null)" and actions["scratch_2"] == "dropped (89% null)"


def test_a_column_can_give_the_order(spark):
    df = spark.createDataFrame([(3, "2024-02-01"), (1, "2024-01-01"), (2, None)], "`Row Id` int, Day string")
    rows = clean(df, order_by="Row Id").table.orderBy("row_id").collect()
    assert [r["day"].month for r in rows] == [1, 1, 2]


def test_cleaned_rows_as_records(cleaned):
    cells = json.loads(records(cleaned.table.where("parcel_no = 5000")).first()["record"])
    assert list(cells) == ["sent_on", "weight_kg", "depot", "express", "label", "pieces", "parcel_no"]
    assert cells["sent_on"] == "2022-01-01T00:00:00" and cells["parcel_no"] == 5000


def test_the_order_column_must_have_every_position_once(spark):
    types = {"o": "integer", "d": "datetime"}
    with pytest.raises(ValueError, match="missing values"):
        filled(spark, [(1, "2024-01-01"), (2, None), (None, "2024-05-05")], "o int, d string", types, order_by="o")
    with pytest.raises(ValueError, match="repeats"):
        filled(spark, [(1, "2024-01-01"), (2, None), (2, "2024-05-05")], "o int, d string", types, order_by="o")
    assert filled(spark, [(1, "2024-01-01"), (None, "2024-05-05")], "o int, d string", types, order_by="o").table.count() == 2
