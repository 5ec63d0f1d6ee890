"""The forest over cells against plain versions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from firstlook.models import forest
from firstlook.models.forest import Forest, ForestModel, fewer_cuts, grown


def plain(bins: np.ndarray, label: np.ndarray, times: np.ndarray, depth: int) -> np.ndarray:
    """Predictions of a tree of least squares that is grown over rows, node by node."""
    def error(rows):
        mean = np.average(label[rows], weights=times[rows])
        return (times[rows] * (label[rows] - mean) ** 2).sum()

    out = np.full(len(label), np.nan)

    def split(rows, level):
        drawn = rows[times[rows] > 0]
        out[rows] = np.average(label[drawn], weights=times[drawn])
        best = (1e-9 * max(error(drawn), 1e-12), None)
        for k in range(len(bins)) if level < depth else ():
            for cut in range(31):
                left = bins[k] <= cut
                sides = drawn[left[drawn]], drawn[~left[drawn]]
                if min(map(len, sides)) and (gain := error(drawn) - sum(map(error, sides))) > best[0] * (1 + 1e-9):
                    best = gain, left
        if best[1] is not None:
            split(rows[best[1][rows]], level + 1)
            split(rows[~best[1][rows]], level + 1)

    split(np.arange(len(label)), 0)
    return out


@pytest.mark.parametrize("depth", [0, 1, 3, 10])
def test_a_tree_over_cells_is_the_one_over_rows(depth):
    random = np.random.default_rng(depth)
    bins = np.stack([random.integers(0, 6, 400), random.integers(0, 2, 400), random.integers(0, 4, 400)]).astype(np.uint8)
    label = 1e6 + bins[0] * 2.0 - (bins[1] & (bins[2] > 1)) * 5 + random.normal(0, 1, 400)
    times = random.poisson(1.0, 400).astype(float)
    found, of = np.unique(bins, axis=1, return_inverse=True)
    of = of.ravel()
    tree = grown(found, np.bincount(of, times), np.bincount(of, times * label), depth)
    assert tree.scores(bins) == pytest.approx(plain(bins, label, times, depth), rel=1e-12)
    assert len(tree.feature) <= 2 ** (depth + 1) - 1


def test_cuts():
    assert fewer_cuts(np.arange(31.0)).tolist() == list(range(31))
    assert len(fewer_cuts(np.arange(254.0))) == 31 and set(fewer_cuts(np.arange(254.0))) >= {0.0, 253.0}


@pytest.fixture(scope="module")
def few_cells(spark):
    """20,000 rows of 24 cells, in some of which the label is noise, with partitions that have no rows."""
    rows = spark.range(20_000).select(((F.col("id") % 8).cast("double")).alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.randn(5).alias("noise"))
    rows = rows.select("a", "b", (10 * F.col("a") - 25 * F.col("b") + F.col("noise")).alias("label"), array_to_vector(F.array("a", "b")).alias("features"))
    return rows.union(rows.limit(0)).persist()


def test_rows_of_few_cells_are_read_once(spark, few_cells):
    model = Forest(30, 6, 1).fit(few_cells)
    assert isinstance(model, ForestModel) and len(model.trees) == 30
    off = F.avg((F.col("label") - F.col("prediction")) ** 2)
    assert model.transform(few_cells).agg(off).first()[0] < 1.1
    again = Forest(30, 6, 1).fit(few_cells)
    seen = few_cells.select("features").distinct()
    key = lambda m: sorted((tuple(r["features"]), round(r["prediction"], 6)) for r in m.transform(seen).collect())
    assert key(model) == key(again) and len({tuple(t.value.tolist()) for t in model.trees}) == 30
    means = few_cells.groupBy("a", "b").agg(F.avg("label").alias("mean"), F.first("features").alias("features"))
    assert model.transform(means).agg(F.max(F.abs(F.col("mean") - F.col("prediction")))).first()[0] < 0.3


def test_many_cells_are_left_to_sparks_forest(few_cells, monkeypatch):
    monkeypatch.setattr(forest, "MOST_CELLS", 23)
    model = Forest(3, 3, 1).fit(few_cells)
    assert isinstance(model, RandomForestRegressionModel) and "prediction" in model.transform(few_cells).columns
