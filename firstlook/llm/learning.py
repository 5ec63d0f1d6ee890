"""Bounded, repeatable samples of labelled and unlabelled rows to fit a classifier on, and its optimiser."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts. Null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a row is kept from training; a row without an id is never held out, and has no label either."""
    return F.coalesce(fold(doc_id, parts) == part, F.lit(False))


def labels_by_id(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row for each id with a label of 0 or 1; the largest where rows disagree."""
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    )


def few(ids: DataFrame, most: int, salt: str) -> DataFrame:
    """At most so many rows, those whose id hashes lowest: the same ones in every run."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(most)


def with_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(ids' columns, text): the text of each sampled row; of an id that repeats, the text that hashes lowest. The sample is bounded by few(), so it
    is small enough to send to every task."""
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy(*ids.columns).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def adam(start: list[np.ndarray], gradients: Callable, steps: int, rate: float, after: Callable | None = None) -> list[np.ndarray]:
    """Parameters after so many steps of Adam; gradients(parameters, step) gives one array each."""
    now = [p.astype(float).copy() for p in start]
    mean, square = [np.zeros_like(p) for p in now], [np.zeros_like(p) for p in now]
    for step in range(1, steps + 1):
        for k, g in enumerate(gradients(now, step)):
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            now[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        if after is not None:
            after(now)
    return now


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
