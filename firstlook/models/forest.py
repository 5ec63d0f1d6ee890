"""A regression forest over cells: rows of equal bins, drawn row by row and then put together.

Trees over bins cannot tell rows of a cell apart. One pass draws for each row how often it is in each tree's sample (Poisson numbers, as in Spark's forest) and adds
up draws and labels by cell and tree; then each tree is grown by itself over cells, level by level, in one task. So the rows are read once, not once for each level.
Where rows have nearly as many cells as there are rows, nothing would be saved, and Spark's own forest is fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from .binned import as_array, bin_edges, binned, cells, matrix
from .boosting import Tree

#: As many bins as Spark's forests have.
BINS = 32
#: Cells are used if there are no more than so many, and at least so many rows for each of them.
MOST_CELLS, ROWS_A_CELL = 10_000, 50
GROWN = "feature array<int>, bin array<int>, left array<int>, right array<int>, value array<double>"


def fewer_cuts(cuts: np.ndarray) -> np.ndarray:
    """At most so many cuts that they make BINS bins, evenly picked."""
    return cuts if len(cuts) < BINS else cuts[np.linspace(0, len(cuts) - 1, BINS - 1).round().astype(int)]


def as_column(bins: np.ndarray) -> pa.Array:
    """Bins (feature, row) as a column of bytes."""
    flat = np.ascontiguousarray(bins.T)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(bins)), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def grown(bins: np.ndarray, times: np.ndarray, sums: np.ndarray, depth: int) -> Tree:
    """The tree of least squares over cells (feature, cell) with draws and sums of labels; splits have a draw on either side, and there are ``depth`` levels of them."""
    own = times > 0
    bins, times = np.minimum(bins[:, own], BINS - 1).astype(np.int64), times[own]
    mean = sums[own].sum() / max(times.sum(), 1)
    sums = sums[own] - mean * times  # what is left of large labels would be lost in squares
    tree = Tree()
    nodes, slot = np.array([tree.add()]), np.zeros(len(times), np.int64)
    for level in range(depth + 1):
        n = len(nodes)
        weight, total = np.bincount(slot, times, n), np.bincount(slot, sums, n)
        for node, value in zip(nodes.tolist(), (mean + total / np.maximum(weight, 1)).tolist()):
            tree.value[node] = value
        if level == depth:
            break
        gains = np.empty((n, len(bins), BINS - 1))
        whole = total**2 / np.maximum(weight, 1)
        for k, own in enumerate(bins):
            place = slot * BINS + own
            left, left_sum = (np.cumsum(np.bincount(place, x, n * BINS).reshape(n, BINS), 1)[:, :-1] for x in (times, sums))
            right, right_sum = weight[:, None] - left, total[:, None] - left_sum
            gain = left_sum**2 / np.maximum(left, 1) + right_sum**2 / np.maximum(right, 1) - whole[:, None]
            gains[:, k] = np.where(np.minimum(left, right) >= 1, gain, -1.0)
        flat = gains.reshape(n, -1)
        best = flat.argmax(1)
        feature, cut = np.divmod(best, BINS - 1)
        split = flat[np.arange(n), best] > 1e-9 * np.maximum(whole, 1e-300)
        if not split.any():
            break
        children = np.full((n, 2), -1)
        for at in np.flatnonzero(split).tolist():
            node = int(nodes[at])
            tree.feature[node], tree.bin[node] = int(feature[at]), int(cut[at])
            tree.left[node], tree.right[node] = children[at] = tree.add(), tree.add()
        stay = split[slot]
        bins, times, sums, slot = bins[:, stay], times[stay], sums[stay], slot[stay]
        goes = (bins[feature[slot], np.arange(len(slot))] > cut[slot]).astype(np.int64)
        nodes, slot = np.unique(children[slot, goes], return_inverse=True)
    return tree


@dataclass
class ForestModel:
    """A fitted forest; transform adds the mean of its trees as prediction."""

    edges: list[np.ndarray]
    trees: list[Tree]

    def scores(self, values: np.ndarray) -> np.ndarray:
        found, of = np.unique(binned(values, self.edges), axis=1, return_inverse=True)
        return (sum(t.scores(found) for t in self.trees) / len(self.trees))[of.ravel()]

    def transform(self, df: DataFrame) -> DataFrame:
        width, scores = len(self.edges), self.scores

        @F.pandas_udf("double")
        def score(features: pd.Series) -> pd.Series:
            return pd.Series(scores(np.array([np.asarray(v, float) for v in features]).reshape(len(features), width)))

        return df.withColumn("prediction", score(as_array(df, "features")))


@dataclass
class Forest:
    """Trees of least squares on samples of the rows with replacement, each with all features; fit reads label and features."""

    trees: int
    depth: int
    seed: int

    def fit(self, df: DataFrame) -> ForestModel | RandomForestRegressionModel:
        rows = df.select("label", "features")
        edges = [fewer_cuts(cuts) for cuts in bin_edges(rows)]
        known = cells(rows, edges, False).select("bins", "rows").limit(MOST_CELLS + 1).collect() if edges else []
        if not known or len(known) > MOST_CELLS or sum(r["rows"] for r in known) < ROWS_A_CELL * len(known):
            return RandomForestRegressor(featureSubsetStrategy="all", numTrees=self.trees, maxDepth=self.depth, seed=self.seed).fit(df)
        names = sorted(bytes(r["bins"]) for r in known)
        trees, depth, seed, width = self.trees, self.depth, self.seed, len(edges)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            random, cell_names = np.random.default_rng([seed, part]), pa.array(names, pa.binary())
            times, sums = np.zeros((trees, len(names))), np.zeros((trees, len(names)))
            for batch in filter(len, batches):
                cell = pc.index_in(as_column(binned(matrix(batch["features"], width), edges)), value_set=cell_names).to_numpy()
                order = np.argsort(cell, kind="stable")
                cell, label = cell[order], batch["label"].to_numpy()[order]
                starts = np.flatnonzero(np.diff(cell, prepend=-1))
                drawn = random.poisson(1.0, (len(cell), trees)).astype(float)
                times[:, cell[starts]] += np.add.reduceat(drawn, starts, 0).T
                sums[:, cell[starts]] += np.add.reduceat(drawn * label[:, None], starts, 0).T
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array(range(trees), pa.int32()), "part": pa.array([part] * trees, pa.int32()),
                "times": pa.array([x.tobytes() for x in times], pa.binary()), "sums": pa.array([x.tobytes() for x in sums], pa.binary()),
            })

        def grow(some: pa.Table) -> pa.Table:
            some = some.sort_by("part")
            times, sums = (sum(np.frombuffer(x.as_py()) for x in some[c]) for c in ("times", "sums"))
            bins = np.frombuffer(b"".join(names), np.uint8).reshape(-1, width).T
            tree = grown(bins, times, sums, depth)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            columns = [pa.array([x], pa.list_(kind)) for x, kind in zip((tree.feature, tree.bin, tree.left, tree.right, tree.value), kinds)]
            return pa.table([some["tree"].slice(0, 1), *columns], names=["tree", "feature", "bin", "left", "right", "value"])

        numbers = rows.select(F.col("label").cast("double").alias("label"), as_array(rows, "features").alias("features"))
        drawn = numbers.mapInArrow(draw, "tree int, part int, times binary, sums binary")
        found = drawn.groupBy("tree").applyInArrow(grow, f"tree int, {GROWN}").collect()  # as many rows as trees
        made = [[np.array(r[c]) for c in ("feature", "bin", "left", "right", "value")] for r in sorted(found, key=lambda r: r["tree"])]
        return ForestModel(edges, [Tree(f, b, np.zeros(len(f), bool), left, right, value) for f, b, left, right, value in made])
