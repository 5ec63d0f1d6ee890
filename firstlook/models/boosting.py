"""Gradient boosting over histograms, with trees grown leaf by leaf.

Each round adds one tree, or one for each of three or more classes. A tree always splits the leaf that gains most next, up to 31 leaves. What a split gains follows
from sums of gradients by leaf, feature and bin; a step adds them up for all leaves that may be split next, the smaller child of each pair, and the
other one is the difference to the parent. Splits looked at too early are thrown away, so trees are the ones that strictly one leaf at a time would give, in as
many steps as a tree is deep. Sums are of fixed size whatever the rows, and the trees of a round share every step.

Rows with equal bins are put together before (see binned). A score is the same for all rows of a cell, so nothing is lost. If there are few cells, however many
rows, they are small enough for the driver, where a step takes a millisecond; otherwise each step is a job over cells that executors hold.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import free_name
from .binned import MISSING, SLOTS, Cells, added_up, as_array, bin_edges, binned, blocks, cells

# Sizes of the model and limits of a split.
ROUNDS = 100
LEARNING_RATE = 0.1
MOST_LEAVES = 31
LEAST_ROWS = 20
LEAST_HESSIAN = 1e-3
PATIENCE = 10
TOLERANCE = 1e-7
#: The driver takes the cells if their bins are no more than so many bytes and cells.
HERE_BYTES, HERE_CELLS = 32 << 20, 1 << 20


@dataclass
class Tree:
    """Node i splits on feature[i] at bin[i] into left[i] and right[i], or is a leaf with a value if feature[i] is -1."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        feature, cut, to_left = np.array(self.feature), np.array(self.bin), np.array(self.missing_left)
        down = np.stack([self.right, self.left])
        node, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        while len(rows):
            at = node[rows]
            inner = feature[at] >= 0
            rows, at = rows[inner], at[inner]
            own = bins[feature[at], rows]
            goes = np.where(own == MISSING, to_left[at], own <= cut[at])
            node[rows] = down[goes.astype(np.int8), at]
        return node

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: np.ndarray  # sums of gradient, hessian and rows
    right: np.ndarray


def best_split(sums: np.ndarray) -> Split | None:
    """The split of a leaf that gains most, from sums (feature, bin, [gradient, hessian, rows]); of equal ones the first feature and bin."""
    whole = sums[0].sum(0)
    strength = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1], 1e-300)
    below = np.cumsum(sums[:, : MISSING - 1], 1)
    missing = sums[:, MISSING][:, None]
    best = None
    for missing_left in (False, True):
        if missing_left and not missing[..., 2].any():
            break
        left = below + missing if missing_left else below
        right = whole - left
        allowed = (np.minimum(left[..., 2], right[..., 2]) >= LEAST_ROWS) & (np.minimum(left[..., 1], right[..., 1]) >= LEAST_HESSIAN)
        gain = np.where(allowed, strength(left) + strength(right) - strength(whole), -1.0)
        # Sums differ in their last digits from run to run; what is equal but for them counts as equal.
        k, b = np.unravel_index(int(np.argmax(gain >= gain.max() * (1 - 1e-9))), gain.shape)
        if gain[k, b] > max(1e-12 * strength(whole), best.gain * (1 + 1e-9) if best else 0.0):
            best = Split(float(gain[k, b]), int(k), int(b), missing_left, left[k, b], right[k, b])
    return best


def histograms(bins: np.ndarray, slot: np.ndarray, slots: int, weights: list[np.ndarray]) -> np.ndarray:
    """Sums (slot, feature, bin, weight) over the cells with a slot of 0 or more."""
    own = np.flatnonzero(slot >= 0)
    place, out, size = slot[own] * SLOTS, np.empty((slots, len(bins), SLOTS, len(weights))), slots * SLOTS
    weights = [w[own] for w in weights]
    for k in range(len(bins)):
        at = place + bins[k, own]
        for j, weight in enumerate(weights):
            out[:, k, :, j] = np.bincount(at, weight, size).reshape(slots, SLOTS)
    return out


class Growing:
    """One tree while it grows, with all splits looked at so far."""

    def __init__(self, sums: np.ndarray):
        self.tree = Tree()
        self.sums, self.total, self.split = {}, {}, {}
        self._look(self.tree.add(), sums)

    def _look(self, node: int, sums: np.ndarray) -> None:
        self.sums[node], self.total[node], self.split[node] = sums, sums[0].sum(0), best_split(sums)

    def chosen(self) -> tuple[list[int], list[int]]:
        """Nodes to split, by strict order of gain, as far as is known; and nodes whose children have to be looked at to go on."""
        order, splits, leaves = [], [], 1
        push = lambda node: self.split[node] and heapq.heappush(order, (-self.split[node].gain, node))
        push(0)
        while order and leaves < MOST_LEAVES:
            node = order[0][1]
            if leaves + 1 < MOST_LEAVES and self.tree.feature[node] < 0:
                return splits, [n for _, n in heapq.nsmallest(MOST_LEAVES - leaves, order) if self.tree.feature[n] < 0]
            heapq.heappop(order)
            splits.append(node)
            leaves += 1
            if self.tree.feature[node] >= 0:
                push(self.tree.left[node])
                push(self.tree.right[node])
        return splits, []

    def open(self, nodes: list[int]) -> dict[int, int]:
        """Split nodes for a look at their children; gives the child of each to be summed up, and its slot."""
        slots = {}
        for node in nodes:
            split, tree = self.split[node], self.tree
            children = [tree.add(), tree.add()]
            tree.feature[node], tree.bin[node], tree.missing_left[node], (tree.left[node], tree.right[node]) = split.feature, split.bin, split.missing_left, children
            for child, total in zip(children, (split.left, split.right)):
                self.total[child], self.split[child] = total, None
            if max(split.left[2], split.right[2]) >= 2 * LEAST_ROWS:
                slots[children[int(split.right[2] < split.left[2])]] = len(slots)
        return slots

    def told(self, nodes: list[int], slots: dict[int, int], sums: np.ndarray) -> None:
        for node in nodes:
            pair = [self.tree.left[node], self.tree.right[node]]
            if pair[0] in slots or pair[1] in slots:
                small = pair[0] if pair[0] in slots else pair[1]
                other = pair[1] if small == pair[0] else pair[0]
                self._look(small, sums[slots[small]])
                self._look(other, self.sums[node] - sums[slots[small]])
            del self.sums[node]

    def done(self, rate: float) -> Tree:
        """The tree of the chosen splits alone."""
        splits, out = set(self.chosen()[0]), Tree()
        stack = [(0, out.add())]
        while stack:
            node, at = stack.pop()
            total = self.total[node]
            if node not in splits:
                out.value[at] = float(-rate * total[0] / max(total[1], 1e-15))
                continue
            split = self.split[node]
            out.feature[at], out.bin[at], out.missing_left[at] = split.feature, split.bin, split.missing_left
            out.left[at], out.right[at] = out.add(), out.add()
            if self.tree.feature[node] >= 0:
                stack += [(self.tree.left[node], out.left[at]), (self.tree.right[node], out.right[at])]
                continue
            for child, side in ((out.left[at], split.left), (out.right[at], split.right)):
                out.value[child] = float(-rate * side[0] / max(side[1], 1e-15))
        return out


def slopes(kind: str, label: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient and hessian (class, row) of the loss, and the loss of each row. kind: squares, or classes numbered from 0."""
    if kind == "squares":
        gradient = score - label
        return gradient, np.ones_like(gradient), 0.5 * gradient[0] ** 2
    if len(score) == 1:
        chance = 1 / (1 + np.exp(-score))
        return chance - label, chance * (1 - chance), np.logaddexp(0, score[0]) - label * score[0]
    high = score.max(0)
    total = high + np.log(np.exp(score - high).sum(0))
    chance, own = np.exp(score - total), np.arange(len(score))[:, None] == label
    return chance - own, chance * (1 - chance), total - score[label.astype(int), np.arange(len(label))]


@dataclass
class State:
    """A block of cells with their scores so far. Scores travel with their cells, so a lost block is made anew as a whole."""

    cells: Cells
    score: np.ndarray

    def after(self, trees: list[Tree]) -> "State":
        return State(self.cells, self.score + np.stack([t.scores(self.cells.bins) for t in trees])) if trees else self

    def sums(self, kind: str, growing: list[Tree], slots: list[dict[int, int]], first: bool) -> np.ndarray:
        """Histograms of all classes, flat, and with the first look of a round the losses of fitted and held-back rows."""
        own, out = self.cells, []
        gradient, hessian, loss = slopes(kind, own.label, self.score)
        for k, (tree, wanted) in enumerate(zip(growing, slots)):
            place = np.full(max(len(tree.feature), 1), -1)
            place[list(wanted)] = list(wanted.values())
            slot = np.where(own.held, -1, place[tree.leaves(own.bins)])
            out.append(histograms(own.bins, slot, len(wanted), [gradient[k] * own.rows, hessian[k] * own.rows, own.rows]).ravel())
        whole = loss * own.rows + 0.5 * own.spread
        losses = [x[part].sum() for x in (whole, own.rows) for part in (~own.held, own.held)] if first else []
        return np.concatenate([*out, losses])


class Here:
    """All blocks of cells, on the driver."""

    def __init__(self, states: list[State]):
        self.states = states

    def grown(self, trees: list[Tree]) -> None:
        self.states = [s.after(trees) for s in self.states]

    def sums(self, *args) -> np.ndarray:
        return sum(s.sums(*args) for s in self.states)

    def close(self) -> None:
        self.states = []


class There:
    """All blocks of cells, on executors; each round's scores replace those before."""

    def __init__(self, states: "RDD[State]"):
        self.states, self.before = states.persist(StorageLevel.MEMORY_AND_DISK), None

    def grown(self, trees: list[Tree]) -> None:
        self.before = self.states
        self.states = self.before.map(lambda s: s.after(trees)).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, *args) -> np.ndarray:
        def look(some):
            parts = [s.sums(*args) for s in some]
            yield sum(parts) if parts else 0.0

        found = added_up(self.states.mapPartitions(look))
        if self.before is not None:  # the new scores are made by now
            self.before.unpersist()
            self.before = None
        return found

    def close(self) -> None:
        self.states.unpersist()


@dataclass
class BoostedTrees:
    """A fitted model; transform adds prediction and, for classes, probability."""

    kind: str
    edges: list[np.ndarray]
    start: np.ndarray
    rounds: list[list[Tree]]
    losses: list[tuple[float, float]]  # of each round, before its trees: mean over fitted and over held-back rows

    def scores(self, values: np.ndarray) -> np.ndarray:
        state = State(Cells(binned(values, self.edges), *[np.zeros(0)] * 4), np.repeat(self.start[:, None], len(values), 1))
        for trees in self.rounds:
            state = state.after(trees)
        return state.score.T

    def transform(self, df: DataFrame) -> DataFrame:
        raw = free_name(df, "_score")
        score = F.pandas_udf(self._scorer(), "array<double>")
        scored = df.withColumn(raw, score(as_array(df, "features")))
        if self.kind == "squares":
            return scored.withColumn("prediction", F.element_at(raw, 1)).drop(raw)
        if len(self.start) == 1:
            yes = 1 / (1 + F.exp(-F.element_at(raw, 1)))
            chances, best = F.array(1 - yes, yes), (F.element_at(raw, 1) > 0).cast("int")
        else:
            total = F.reduce(F.transform(raw, lambda s: F.exp(s - F.array_max(raw))), F.lit(0.0), lambda a, b: a + b)
            scored = scored.withColumn("probability", total)
            chances, best = F.transform(raw, lambda s: F.exp(s - F.array_max(raw)) / F.col("probability")), F.array_position(raw, F.array_max(raw)) - 1
        return scored.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector(chances)).drop(raw)

    def _scorer(self) -> Callable[[pd.Series], pd.Series]:
        def score(features: pd.Series) -> pd.Series:
            values = np.array([np.asarray(v, float) for v in features]).reshape(len(features), -1)
            return pd.Series(list(self.scores(values)))

        return score


@dataclass
class Boosting:
    """Boosting for numbers ("squares") or classes numbered from 0; fit reads label, features and, if asked to, is_validation.

    With held-back rows it stops when their loss has not fallen by more than a trace for ten rounds.
    """

    kind: str
    classes: int = 0
    rounds: int = ROUNDS
    rate: float = LEARNING_RATE
    use_validation: bool = False

    def fit(self, df: DataFrame) -> BoostedTrees:
        df = df if self.use_validation else df.drop("is_validation")
        fitted = df.filter(~F.col("is_validation")) if self.use_validation else df
        edges = bin_edges(fitted)
        start = self._start(fitted)
        model = BoostedTrees(self.kind, edges, start, [], [])
        if not edges:
            return model
        found = cells(df, edges, self.kind != "squares").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            count = found.count()
            parts = blocks(found.coalesce(max(1, min(found.rdd.getNumPartitions(), count // 10_000))), len(edges))
            states = parts.map(lambda b: State(b, np.repeat(start[:, None], len(b.label), 1)))
            data = Here(states.collect()) if count * len(edges) <= HERE_BYTES and count <= HERE_CELLS else There(states)
            try:
                while len(model.rounds) < self.rounds and (trees := self._round(data, model)) is not None:
                    model.rounds.append(trees)
                    data.grown(trees)
            finally:
                data.close()
        finally:
            found.unpersist()
        return model

    def _start(self, df: DataFrame) -> np.ndarray:
        if self.kind == "squares":
            return np.array([df.agg(F.avg("label")).first()[0] or 0.0])
        counts = {int(r[0]): r[1] for r in df.groupBy("label").count().collect()}
        share = np.array([counts.get(k, 0) for k in range(max(self.classes, 2))]) / max(1, sum(counts.values()))
        share = np.clip(share, 1e-9, 1 - 1e-9)
        return np.array([np.log(share[1] / share[0])]) if len(share) == 2 else np.log(share)

    def _round(self, data: Here | There, model: BoostedTrees) -> list[Tree] | None:
        """The trees of the next round; None if it is time to stop."""
        classes, features = len(model.start), len(model.edges)
        root = Tree()
        root.add()
        sums = data.sums(self.kind, [root] * classes, [{0: 0}] * classes, True)
        fit_loss, held_loss, fit_rows, held_rows = sums[-4:]
        model.losses.append((fit_loss / max(fit_rows, 1), held_loss / max(held_rows, 1)))
        if held_rows and len(model.losses) > PATIENCE and min(x[1] for x in model.losses[-PATIENCE:]) > model.losses[-PATIENCE - 1][1] - TOLERANCE:
            return None
        growing = [Growing(s) for s in sums[:-4].reshape(classes, features, SLOTS, 3)]
        while any(nodes := [g.chosen()[1] for g in growing]):
            slots = [g.open(n) for g, n in zip(growing, nodes)]
            sums = data.sums(self.kind, [g.tree for g in growing], slots, False) if any(slots) else np.zeros(0)
            cuts = np.cumsum([len(s) * features * SLOTS * 3 for s in slots])[:-1]
            for g, n, s, own in zip(growing, nodes, slots, np.split(sums, cuts)):
                g.told(n, s, own.reshape(len(s), features, SLOTS, 3))
        return [g.done(self.rate) for g in growing]
