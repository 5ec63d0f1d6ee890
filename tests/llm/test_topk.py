import random

import pytest
from pyspark.sql import functions as F

from firstlook.llm import topk
from firstlook.llm.topk import exact_top_k, whole_weights

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def vectors(spark):
    random.seed(2)
    rows = [(k, [random.choice([0.0, 0.5, -1.25, 0.004]) for _ in range(random.choice([3, 8]))], "x") for k in range(-20, 200)]
    rows += [(7, rows[3][1], "x"), (None, [1.0], "x"), (900, None, "x"), (901, [1.0, None], "x"), (902, [NAN], "x"), (903, [-INF], "x"), (950, [], "x")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, weights string")


def plain(rows, k):
    import math

    good = [
        (i, [math.floor(256 * x) for x in v]) for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    want = set()
    for q, a in good:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
            want.update((q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1))
    return want


@pytest.mark.parametrize("k, sizes", [(5, (16_384, 2_048)), (5, (37, 2)), (500, (64, 3))])
def test_equal_to_comparing_all(vectors, monkeypatch, k, sizes):
    rows, table = vectors
    monkeypatch.setattr(topk, "CANDIDATES_A_BLOCK", sizes[0])
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", sizes[1])
    monkeypatch.setattr(topk, "SCORES_AT_ONCE", 100)
    weighted = table.select(F.col("vec_id").alias("id"), whole_weights(F.col("embedding").cast("array<double>"), 256).alias("weights"))
    # floats are read as doubles before scaling, as Python's are
    exact = [(i, None if v is None else [None if x is None else _float(x) for x in v], c) for i, v, c in rows]
    assert {tuple(r) for r in exact_top_k(weighted.filter("id % 50 = 0"), weighted, k).collect()} == plain(exact, k)


def _float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_no_rows(vectors):
    table = vectors[1].select(F.col("vec_id").alias("id"), F.array(F.lit(1).cast("long")).alias("weights"))
    none = table.filter("id > 100000")
    assert exact_top_k(none, table, 5).count() == 0
    assert exact_top_k(table.limit(3), none, 5).count() == 0
