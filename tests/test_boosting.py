"""Histogram boosting against a plain version that grows one leaf at a time over all rows."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from firstlook.models import boosting
from firstlook.models.binned import MISSING, bin_edges, binned
from firstlook.models.boosting import Boosting, slopes


def rows(seed: int, n: int = 3000, classes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 7, n), rng.exponential(size=n).round(2), np.full(n, 3.0)])
    x[rng.random(n) < 0.15, 0] = np.nan
    y = np.where(np.isnan(x[:, 0]), 2.0, np.sin(2 * x[:, 0])) + (x[:, 1] > 3) * x[:, 2] + rng.normal(scale=0.1, size=n)
    return x, y if not classes else np.digitize(y, np.quantile(y, np.linspace(0, 1, classes + 1)[1:-1])).astype(float)


def table(spark, x, y):
    return spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "label double, features array<double>").repartition(3).persist()


def plain_tree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
    """Score of each row under a tree that splits the leaf of the highest gain, one after the other."""
    leaves, scores = [np.arange(len(g))], np.zeros(len(g))

    def best(own):
        found = (0.0, None)
        whole = g[own].sum() ** 2 / h[own].sum()
        for missing in (False, True):
            for k in range(len(bins)):
                for cut in range(MISSING - 1):
                    left = (bins[k, own] <= cut) | (missing & (bins[k, own] == MISSING))
                    a, b = own[left], own[~left]
                    if min(len(a), len(b)) < 20 or min(h[a].sum(), h[b].sum()) < 1e-3:
                        continue
                    gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - whole
                    if gain > found[0] + 1e-9:
                        found = (gain, (a, b))
        return found

    looked = {0: best(leaves[0])}
    while len(leaves) < boosting.MOST_LEAVES and max(v[0] for v in looked.values()) > 1e-9:
        k = max(looked, key=lambda i: looked[i][0])
        a, b = looked.pop(k)[1]
        leaves[k] = a
        leaves.append(b)
        looked[k], looked[len(leaves) - 1] = best(a), best(b)
    for own in leaves:
        scores[own] = -rate * g[own].sum() / h[own].sum()
    return scores


@pytest.mark.parametrize("classes, here", [(0, True), (0, False), (2, True), (3, False)])
def test_two_rounds_equal_a_plain_version(spark, monkeypatch, classes, here):
    """On the driver and on executors, with every row twice."""
    monkeypatch.setattr(boosting, "HERE_CELLS", 1 << 20 if here else 0)
    x, y = rows(1, 350, classes)
    x, y = np.concatenate([x, x]), np.concatenate([y, y])
    kind = "classes" if classes else "squares"
    model = Boosting(kind, classes, rounds=2).fit(table(spark, x, y))
    bins = binned(x, model.edges)
    score = np.repeat(model.start[:, None], len(y), 1)
    for trees in model.rounds:
        g, h, loss = slopes(kind, y, score)
        for k, tree in enumerate(trees):
            want = plain_tree(bins, g[k], h[k], 0.1)
            assert np.allclose(tree.scores(bins), want)
            assert sum(f < 0 for f in tree.feature) <= boosting.MOST_LEAVES
            score[k] += want
    assert np.allclose(model.scores(x), score.T)


@pytest.mark.parametrize("classes", [2, 4])
def test_loss_falls_in_every_round(spark, classes):
    x, y = rows(2, classes=classes)
    df = table(spark, x, y)
    model = Boosting("classes", classes, rounds=12).fit(df)
    losses = [a for a, _ in model.losses]
    assert all(b < a for a, b in zip(losses, losses[1:])) and len(model.rounds[0]) == (1 if classes == 2 else classes)
    found = model.transform(df).select("label", "prediction", vector_to_array("probability").alias("p")).toPandas()
    assert (found.label == found.prediction).mean() > 0.75
    p = np.stack(found.p)
    assert p.shape[1] == classes and np.allclose(p.sum(1), 1) and (p.argmax(1) == found.prediction).all()


def test_numbers_are_learned_and_edges_cover_few_values(spark):
    x, y = rows(3)
    df = table(spark, x, y)
    edges = bin_edges(df)
    assert [len(e) for e in edges[1::2]] == [6, 0] and all(len(e) <= 254 for e in edges)
    model = Boosting("squares", rounds=60).fit(df)
    found = model.transform(df.withColumn("_score", F.lit("kept"))).toPandas()
    assert set(found.columns) == {"label", "features", "prediction", "_score"} and set(found._score) == {"kept"}
    assert 1 - ((found.label - found.prediction) ** 2).sum() / ((found.label - found.label.mean()) ** 2).sum() > 0.95


def test_held_back_rows_end_a_fit_that_learns_nothing(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(1500, 3)), rng.normal(size=1500)
    df = table(spark, x, y).withColumn("is_validation", F.crc32(F.col("label").cast("string").cast("binary")) % 5 == 0)
    model = Boosting("squares", use_validation=True).fit(df)
    assert len(model.rounds) < 60 and all(v > 0 for _, v in model.losses)
    assert len(Boosting("squares", rounds=15).fit(df).rounds) == 15


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(float(k), [1.0]) for k in range(30)], "label double, features array<double>")
    model = Boosting("squares", rounds=3).fit(df)
    assert {r["prediction"] for r in model.transform(df).collect()} == {14.5}
