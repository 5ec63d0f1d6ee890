"""Small tables: use every core, and read the source once.

A table of a few megabytes often sits in one file, which one task would read again in every pass. Only
tables whose estimated size is below a fixed bound are spread and cached; larger ones are read in as
many tasks as they have splits, and every pass prunes them to the columns it needs.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

SMALL_BYTES = 256 * 1024 * 1024


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate lies below the bound."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL_BYTES


def spread(df: DataFrame) -> DataFrame:
    """A small table in at least as many partitions as there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, F.rand(0)) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """The table for several passes: cached while the block runs if it is small, else as it is."""
    if df.is_cached or not is_small(df):
        yield df
        return
    cached = spread(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield cached
    finally:
        cached.unpersist()
