import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from firstlook.llm import line_dedup
from firstlook.llm.line_dedup import keep_bitmaps, kept_text

from .conftest import SCHEMA, lower

BLANKS = " \t\n\x0b\x0c\r"
LOW = -(1 << 70)


def plain(rows: list[tuple], min_chars: int, min_docs: int) -> list[tuple]:
    holders = defaultdict(set)
    split = [(LOW if i is None else i, (t or "").split("\n")) for i, t in rows]
    keys = lambda lines: [lower(x.strip(BLANKS)) for x in lines]
    for i, lines in split:
        for key in keys(lines):
            if len(key) >= min_chars:
                holders[key].add(i)
    out = []
    for i, lines in split:
        gone = [len(holders[k]) >= min_docs and max(holders[k]) != i for k in keys(lines)]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def ours(docs, min_chars: int, min_docs: int) -> list[tuple]:
    found = keep_bitmaps(docs, min_chars, min_docs, rest=True)
    kept = kept_text(F.coalesce("rest.text", F.lit("")), F.col("keep"))
    rows = found.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256), "keep").collect()
    assert all(sum(r.keep) == r.n_lines and sum(r.keep[1::2]) == r.n_dropped and all(r.keep[1:]) for r in rows)
    return sorted((LOW if r[0] is None else r[0], *r[1:4]) for r in rows)


def shared_rows() -> list[tuple]:
    a, b, c = "A line that MANY hold, É as it is", "another of these lines, long enough", "ëverything äbout ünicode, 1 2 3 4 5"
    rows = [(k, f"{a}\nown {k}\n{'x' * (k % 3)}\n {b.upper()}\t\n{a}") for k in range(40)]
    rows += [(100 + k, f"{c}\n\n{b}") for k in range(4)] + [(104, c.upper()), (105, c + "\x1f")]
    rows += [(7, f"{a}\nagain under a taken id"), (7, f"{a}\nagain under a taken id"), (None, f"{b}\n{c}"), (None, a), (200, None), (201, ""), (-3, "\n\n"), (202, a + "\r\n" + a)]
    return rows + [(300, "\n".join([a, "q" * 50, b] * 400)), (301, "z" * 200_000 + "\n" + a)]


def as_table(spark, rows):
    return spark.createDataFrame([(i, t, *["k"] * 9) for i, t in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("min_chars, min_docs", [(20, 5), (20, 2), (33, 1), (1, 3)])
def test_lines_equal_a_plain_count(spark, min_chars, min_docs):
    rows = shared_rows()
    assert ours(as_table(spark, rows), min_chars, min_docs) == plain(rows, min_chars, min_docs)


def test_hot_lines_are_dealt_into_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SAMPLED_ONE_IN", 1)
    rows = shared_rows()
    docs = as_table(spark, rows)
    assert line_dedup._hot(line_dedup._rows(docs, False), 20, 8).count() > 1
    assert ours(docs, 20, 5) == plain(rows, 20, 5)


def test_odd_rows(odd_docs, odd):
    from .conftest import odd_rows

    rows = [(r[0], r[1]) for r in odd_rows()]
    assert ours(odd_docs, 10, 2) == plain(rows, 10, 2)


def test_no_rows(no_docs):
    assert keep_bitmaps(no_docs).collect() == []


def test_only_sql_functions_run(odd_docs):
    plan = keep_bitmaps(odd_docs, rest=True)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
