"""Rows for training: an exact sample and an exact, stratified split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import q
from ..operators.sample import HASH_SPAN, SEED, exact_sample, row_hash

# Fixed values of the training set.
MAX_ROWS = 50_000
TEST_SHARE = 0.2
SURE = 6  # deviations of a rank among evenly spread hashes


class SplitError(ValueError):
    """The rows cannot be split the way asked."""


def select_rows(df: DataFrame, target: str, key: str, max_rows: int | None = MAX_ROWS) -> tuple[DataFrame, int, int]:
    """Rows with a target, at most ``max_rows`` of them (None: all), with the rows used and the rows there were."""
    present = df.where(q(target).isNotNull())
    total = present.count()
    if max_rows is None:
        return present, total, total
    return exact_sample(present, max_rows, key, rows=total, ordered=False), min(total, max_rows), total


def test_quotas(sizes: dict, test_share: float = TEST_SHARE) -> dict:
    """Test rows per class: their sum is the rounded-up share, split by largest remainder."""
    total = sum(sizes.values())
    n_test = math.ceil(test_share * total)
    n_train = total - n_test
    if min(sizes.values()) < 2:
        raise SplitError("The least populated class has only 1 member, which is too few.")
    for name, size in (("train", n_train), ("test", n_test)):
        if size < len(sizes):
            raise SplitError(f"The {name} size = {size} should be at least the number of classes = {len(sizes)}")
    shares = {c: n * n_train / total for c, n in sizes.items()}
    train = {c: math.floor(s) for c, s in shares.items()}
    by_remainder = sorted(sizes, key=lambda c: (train[c] - shares[c], str(c)))
    for c in by_remainder[: n_train - sum(train.values())]:
        train[c] += 1
    return {c: n - train[c] for c, n in sizes.items()}


def split_rows(df: DataFrame, key: str, label: str | None = None, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: exactly the rounded-up share of rows, per class in proportion when a label is given.

    The rows of a class whose key hashes lowest are tested. Which hash is the last one follows from one aggregate, so that rows are only
    marked, neither sorted nor shuffled. ``key`` is unique.
    """
    place = row_hash(key, seed)
    if label is None:
        total = df.count()
        last = _last_places(df, place, F.lit(0), {0: (math.ceil(test_share * total), total)})
        return df.withColumn("is_test", F.coalesce(place <= F.lit(last.get(0, -1)), F.lit(False)))
    sizes = {r[0]: r[1] for r in df.groupBy(q(label)).count().collect()}
    quotas = test_quotas(sizes, test_share)
    flag = F
    for value, last in _last_places(df, place, q(label), {c: (quotas[c], n) for c, n in sizes.items()}).items():
        flag = flag.when(q(label).eqNullSafe(F.lit(value)), place <= F.lit(last))
    return df.withColumn("is_test", F.coalesce(flag, F.lit(False)))


def _last_places(df: DataFrame, place: Column, group: Column, wanted: dict) -> dict:
    """For each group (rows wanted, rows), the hash of its last wanted row in the order of hashes.

    Hashes are spread evenly, so that of n rows it lies within a few roots of n of its expected place. What lies below that window is
    counted, what lies inside is kept: some dozen times the root of n numbers. Should it lie outside, the window is widened.
    """
    found: dict = {}
    deviations = SURE
    rows = df.select(group.alias("group"), place.alias("place"))
    while open_ := {c: w for c, w in wanted.items() if c not in found and w[0] > 0}:
        low, high = F, F
        for c, (quota, n) in open_.items():
            spread = deviations * math.sqrt(max(quota * (1 - quota / n), 1.0)) + 1
            ends = [min(HASH_SPAN, max(0, int(HASH_SPAN * (quota + side * spread) / n))) for side in (-1, 1)]
            same = F.col("group").eqNullSafe(F.lit(c))
            low, high = low.when(same, F.lit(ends[0])), high.when(same, F.lit(ends[1]))
        bounded = rows.select("group", "place", low.alias("low"), high.alias("high"))
        inside = F.when((F.col("place") >= F.col("low")) & (F.col("place") <= F.col("high")), F.col("place"))
        seen = bounded.groupBy("group").agg(F.count_if(F.col("place") < F.col("low")).alias("below"), F.sort_array(F.collect_list(inside)).alias("inside")).collect()
        for r in seen:
            if r["group"] in open_ and 0 <= (k := open_[r["group"]][0] - 1 - r["below"]) < len(r["inside"]):
                found[r["group"]] = r["inside"][k]
        deviations *= 4
    return found
