"""CSV, datasets and report files."""

import datetime as dt
from random import Random

import pytest
from pyspark.sql import functions as F

from firstlook.operators.clean import clean
from firstlook.operators.types import infer_types
from firstlook.sources.csv import SourceError, header_names, read_csv, write_csv
from firstlook.sources.csv_records import _stays, opens
from firstlook.sources.datasets import Datasets, UnknownDataset, write_report
from firstlook.sources.order import ROW_ORDER
from firstlook.sources.records import records


def csv_of(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def test_header_names():
    assert header_names("a,a,,a,b c") == ["a", "a.1", "Unnamed: 2", "a.2", "b c"]
    assert header_names('﻿"x,y",z') == ["x,y", "z"]


def test_column_types(spark, tmp_path):
    path = csv_of(tmp_path, "i,f,g,b,s,e,long,x\n1,1.5,2,True,a,,99999999999999999999,True\n-2,NA,,false,1,NaN,1,\n+3,1e3,4,TRUE,,null,2,no\n")
    df = read_csv(spark, path)
    assert {c: t for c, t in df.dtypes if c != ROW_ORDER} == {
        "i": "bigint", "f": "double", "g": "double", "b": "boolean", "s": "string", "e": "double", "long": "string", "x": "string"}
    assert [r["f"] for r in df.orderBy(ROW_ORDER).collect()] == [1.5, None, 1000.0]


def test_missing_words_count_before_trimming(spark, tmp_path):
    df = read_csv(spark, csv_of(tmp_path, "k,v\n1,NA\n2, NA\n3,-\n4,None\n5,  \n"))
    assert [r["v"] for r in df.orderBy(ROW_ORDER).collect()] == [None, " NA", "-", None, "  "]


def test_quotes_and_line_breaks(spark, tmp_path):
    df = read_csv(spark, csv_of(tmp_path, 'a,b\n"x ""y"", z",1\n"two\nlines",2\n'))
    assert [r["a"] for r in df.orderBy(ROW_ORDER).collect()] == ['x "y", z', "two\nlines"]


CELLS = ["", "plain", 'a "quoted" word', "two\nlines", "\n", '"', '""', ",", '",\n"', "x" * 90 + "\n" * 5, '\n"\n,', "é\n\nü", "1", " pad "]


def messy_rows(seed: int, count: int, most_cells: int = 14) -> list[list[str]]:
    random = Random(seed)
    return [[str(k), *random.choices(CELLS[:most_cells], k=3)] for k in range(count)]


def as_csv(rows: list[list[str]], random: Random, line_end: str = "\n") -> str:
    """Cells in quotes where they need them, and sometimes where they don't."""
    cell = lambda c: '"' + c.replace('"', '""') + '"' if random.random() < 0.4 or any(x in c for x in '",\n') else c
    return "".join(",".join(map(cell, row)) + line_end for row in [["k", "a", "b", "c"], *rows])


@pytest.mark.parametrize("seed, split, line_end", [(1, "64", "\n"), (2, "100", "\r\n"), (3, "1000", "\n"), (4, "37", "\n")])
def test_records_of_several_lines_in_many_splits(spark, tmp_path, seed, split, line_end):
    folder, want = tmp_path / "quoted", []
    folder.mkdir()
    for part in range(3):
        rows = [[str(1000 * part + int(r[0])), *r[1:]] for r in messy_rows(10 * seed + part, 120)]
        csv_of(folder, as_csv(rows, Random(seed), line_end), f"part-{part}.csv")
        want += [(int(r[0]), *(c or None for c in r[1:])) for r in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        df = read_csv(spark, str(folder))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r)[:4] for r in df.orderBy(ROW_ORDER).collect()] == want


def test_line_effects_equal_a_walk_over_characters(spark):
    def walk(line: str, inside: bool) -> bool:
        state = "quoted" if inside else "start"
        for c in line:
            if state == "quoted":
                state = "quote" if c == '"' else state
            elif state == "quote" and c == '"':
                state = "quoted"
            else:
                state = "start" if c == "," else "quoted" if c == '"' and state == "start" else "bare"
        return state == "quoted"

    random = Random(8)
    lines = ["".join(random.choices('",a', k=random.randint(0, 9))) for _ in range(3000)] + ['"' + '""' * 50_000, "a," * 50_000 + '"']
    df = spark.createDataFrame([(x,) for x in lines], "value string").select("value", opens(F.col("value")).alias("o"), _stays(F.col("value")).alias("s"))
    assert all((r["o"], r["s"]) == (walk(r["value"], False), walk(r["value"], True)) for r in df.collect())


def test_headers_of_a_folder(spark, tmp_path):
    csv_of(tmp_path, "a,b\n1,2\n", "one.csv")
    csv_of(tmp_path, '"a",b\r\n3,4\r\n', "two.csv")
    assert [(r["a"], r["b"]) for r in read_csv(spark, str(tmp_path)).orderBy("a").collect()] == [(1, 2), (3, 4)]
    csv_of(tmp_path, "b,a\n5,6\n", "three.csv")
    with pytest.raises(SourceError, match="different headers: a, b and b, a"):
        read_csv(spark, str(tmp_path))


def test_line_break_in_a_header(spark, tmp_path):
    path = csv_of(tmp_path, '\n"a\nb",c\n1,"x\ny"\n\n2,z\n')
    df = read_csv(spark, path)
    assert df.columns[:2] == ["a\nb", "c"] and [tuple(r)[:2] for r in df.orderBy(ROW_ORDER).collect()] == [(1, "x\ny"), (2, "z")]
    csv_of(tmp_path, '"a\nB",c\n1,2\n', "u.csv")
    with pytest.raises(SourceError, match="different headers"):
        read_csv(spark, str(tmp_path))


def test_lines_of_torn_records_are_not_shuffled(spark, tmp_path):
    rows = [[str(k), f"{k}\n" * (1 + k % 40), "x"] for k in range(400)]
    path = csv_of(tmp_path, as_csv([[*r, "y"] for r in rows], Random(3)))
    settings = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df = read_csv(spark, path)
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert [(str(r["k"]), r["a"], r["b"]) for r in df.orderBy(ROW_ORDER).collect()] == [tuple(r) for r in rows]
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_a_quoted_cell_without_an_end(spark, tmp_path):
    with pytest.raises(SourceError, match="1 file.* inside a quoted cell"):
        read_csv(spark, csv_of(tmp_path, 'a,b\n1,"x\n2,y\n'))


def test_blanks_survive_a_round_trip(spark, tmp_path):
    rows = [(k, f" no {k} \n", '"\r\n, ') for k in range(5)]
    write_csv(spark.createDataFrame(rows, "k int, a string, b string"), str(tmp_path / "out"))
    assert sorted(tuple(r)[:3] for r in read_csv(spark, str(tmp_path / "out")).collect()) == rows


def test_repeated_headers(spark, tmp_path):
    df = read_csv(spark, csv_of(tmp_path, "a,a,A\n1,2,3\n"))
    assert df.columns == ["a", "a.1", "A", ROW_ORDER]
    assert clean(df).report.renamed_columns == {"a": "a", "a.1": "a_1", "A": "a_2"}


def test_order_follows_files(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for part in range(4):
        rows = "".join(f"{part * 100 + i}\n" for i in range(20 * (4 - part)))
        (folder / f"part-{part}.csv").write_text("n\n" + rows)
    got = [r["n"] for r in read_csv(spark, str(folder)).orderBy(ROW_ORDER).collect()]
    assert got == sorted(got) and len(got) == 200


def test_bad_sources(spark, tmp_path):
    with pytest.raises(SourceError, match="extension"):
        read_csv(spark, csv_of(tmp_path, "a\n1\n", "t.xlsx"))
    with pytest.raises(SourceError, match="empty"):
        read_csv(spark, csv_of(tmp_path, "", "empty.csv"))
    with pytest.raises(SourceError, match="no rows"):
        read_csv(spark, csv_of(tmp_path, "a,b\n", "head.csv"))


def test_source_order_fills_dates(spark, tmp_path):
    df = read_csv(spark, csv_of(tmp_path, "d,v\n,1\n2024-01-01,2\n,3\n2024-03-01,4\n2024-04-01,5\n2024-05-01,6\n"))
    rows = clean(df).table.orderBy("v").collect()
    assert [r["d"].month for r in rows] == [1, 1, 1, 3, 4, 5]


def test_written_csv_reads_back(spark, cleaned, tmp_path):
    path = str(tmp_path / "out")
    write_csv(cleaned.table, path)
    back = read_csv(spark, path)
    assert [c for c in back.columns if c != ROW_ORDER] == [c for c in cleaned.table.columns if c != ROW_ORDER]
    assert [r["parcel_no"] for r in back.orderBy(ROW_ORDER).collect()] == list(range(5000, 5240))
    assert infer_types(back.drop(ROW_ORDER))["sent_on"] == "datetime"


def test_datasets(spark, tmp_path):
    kept = Datasets(spark, str(tmp_path / "kept"))
    first = kept.create(spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "a int, t timestamp_ntz"), "a.csv")
    second = kept.create(spark.range(3), "b.csv")
    assert kept.get(first).first()["a"] == 1 and kept.get(second).count() == 3 and kept.source(first) == "a.csv"
    for unknown in ("nope", "../kept", ""):
        with pytest.raises(UnknownDataset):
            kept.get(unknown)


def test_report_files(spark, cleaned, tmp_path):
    path = str(tmp_path / "report")
    write_report(cleaned.report.columns_table(spark), path)
    assert spark.read.json(path).where("detected_type = 'datetime'").first()["name"] == "sent_on"


def test_cells_beyond_the_header_are_an_error(spark, tmp_path):
    (tmp_path / "ragged.csv").write_text("a,b\n1,x\n2,y,EXTRA\n3\n")
    with pytest.raises(SourceError, match="1 row"):
        read_csv(spark, str(tmp_path / "ragged.csv"))
    (tmp_path / "short.csv").write_text("a,b\n1,x\n3\n")
    assert [(r["a"], r["b"]) for r in read_csv(spark, str(tmp_path / "short.csv")).orderBy("a").collect()] == [(1, "x"), (3, None)]


def test_nested_cells_hold_no_nan(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([1.5, nan], (inf, "x"), {"k": -inf})], "a array<double>, s struct<d:double,t:string>, m map<string,double>")
    assert records(df).first()["record"] == '{"a":[1.5,null],"s":{"d":null,"t":"x"},"m":{"k":null}}'
