"""Exact quantiles without holding a column's values in one task.

A mergeable sketch (KLL) of each column tells, in one pass over all columns, values a little below and above each wanted rank. The next pass
counts exactly how many values lie below such a bracket and on its two ends, and, if few enough lie between them, keeps those, which decides the rank; if
not, it sketches what lies between, which makes the bracket some seventy times narrower. A frequent value is an end, not a crowd
inside. The counts are exact, so sketches only decide how fast a bracket shrinks. No values are shuffled, and what tasks send to
the one that merges does not grow with the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions.columns import q
from .ordered import running_total

EXACT_VALUES = 100_000  # values kept for one bracket
EXACT_VALUES_PER_GROUP = 50_000
SKETCH_K = 4_000
#: Ranks that a sketch between the ends is asked for: ends of the next bracket are two of these.
GRID = 500
# Share of the values by which a bracket is wider on either side than the rank: two and a half times what a sketch of this size misses in one case of a hundred.
SLACK = 2.5 * 2.3 / SKETCH_K**0.97


@dataclass(frozen=True)
class Bracket:
    """Where the two ranks next to a quantile lie: from low to high, with about so many values between them."""

    lower: int
    upper: int
    between: int
    low: float
    high: float


def _position(rows: int, fraction: float) -> tuple[float, int, int]:
    """Zero-based position of a linear-interpolation quantile and its two neighbouring ranks."""
    position = fraction * (rows - 1)
    lower = math.floor(position)
    return position, lower, min(lower + 1, rows - 1)


def _sketch(col: Column, k: int) -> Column:
    return F.kll_sketch_agg_double(col, F.lit(k))


def _ends(sketch: Column, shares: list[float]) -> Column:
    """The sketched values at shares of the values; NULL for an empty sketch."""
    inside = F.array(*[F.lit(min(1.0, max(0.0, x))) for x in shares])
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, inside))


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of all values; plans over it stay as small for many columns as for one."""
    cells = F.array(*[F.struct(F.lit(i).alias("column"), q(c).alias("value")) for i, c in enumerate(columns)])
    return df.select(F.inline(cells)).filter("value IS NOT NULL")


def first_brackets(df: DataFrame, columns: list[str], fractions: list[float], sketch_k: int = SKETCH_K) -> tuple[dict[str, int], dict[tuple[str, float], Bracket]]:
    """Rows of each column, and a bracket for each (column, fraction), from one pass."""
    slack = _slack(sketch_k)
    asked = [f + side * slack for f in fractions for side in (-1, 1)]
    made = _cells(df, columns).groupBy("column").agg(F.count("value").alias("rows"), _sketch(F.col("value"), sketch_k).alias("sketch"))
    seen = {r["column"]: r for r in made.select("column", "rows", _ends(F.col("sketch"), asked).alias("ends")).collect()}
    rows, found = {}, {}
    for i, c in enumerate(columns):
        rows[c] = seen[i]["rows"] if i in seen else 0
        for j, f in enumerate(fractions if rows[c] else []):
            _, lower, upper = _position(rows[c], f)
            found[c, f] = Bracket(lower, upper, _between(rows[c], slack), *seen[i]["ends"][2 * j : 2 * j + 2])
    return rows, found


def _slack(sketch_k: int) -> float:
    return SLACK * (SKETCH_K / sketch_k) ** 0.97


def _between(values: int, slack: float) -> int:
    """At most so many values between the ends that a sketch of so many values gave, with room for what it misses itself."""
    return min(values, int(4 * slack * values) + 4)


def _looked(df: DataFrame, columns: list[str], brackets: list[tuple[str, Bracket]], limit: int, sketch_k: int) -> list[Row]:
    """What one pass finds out about brackets: counts below, on and between their ends, and the values of their ranks, or sketched ones between the ends."""
    rows = [(columns.index(c), k, b.lower, b.upper, b.low, b.high, b.between <= limit) for k, (c, b) in enumerate(brackets)]
    asked = df.sparkSession.createDataFrame(rows, "of int, bracket int, lower long, upper long, low double, high double, few boolean")
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    # Broadcast: one row of 40 bytes for each column and quantile.
    cells = _cells(df, columns).join(F.broadcast(asked), (F.col("column") == F.col("of")) & (value <= high))
    between = F.when((value > low) & (value < high), value)
    found = cells.groupBy("bracket", "lower", "upper", "few").agg(
        F.count_if(value < low).alias("below"), F.count_if(value == low).alias("at_low"), F.count(between).alias("between"),
        F.count_if((value == high) & (value != low)).alias("at_high"),
        F.sort_array(F.collect_list(F.when(F.col("few"), between))).alias("kept"),
        *([] if all(r[-1] for r in rows) else [_sketch(F.when(~F.col("few"), between), sketch_k).alias("sketch")]),
    )
    ranks = F.array(*[F.get("kept", (F.col(r) - F.col("below") - F.col("at_low")).cast("int")) for r in ("lower", "upper")])
    grid = _ends(F.col("sketch"), [k / GRID for k in range(GRID + 1)]) if "sketch" in found.columns else F.lit(None).cast("array<double>")
    out = found.select("bracket", "below", "at_low", "between", "at_high", F.when(F.col("few"), ranks).otherwise(grid).alias("values")).collect()
    return sorted(out, key=lambda r: r["bracket"])


def _answer(df: DataFrame, column: str, b: Bracket, seen: Row, limit: int, slack: float) -> tuple[float, float] | Bracket:
    """The values of both ranks, or a narrower bracket."""
    _, below, at_low, between, at_high, values = seen
    inside = [below + at_low <= r < below + at_low + between for r in (b.lower, b.upper)]
    if b.between > limit and all(inside):
        shares = [(b.lower - below - at_low) / between - slack, (b.upper + 1 - below - at_low) / between + slack]
        ends = values[max(0, math.floor(shares[0] * GRID))], values[min(GRID, math.ceil(shares[1] * GRID))]
        return Bracket(b.lower, b.upper, _between(between, slack + 1 / GRID), *ends)

    def at(rank: int, kept: float | None) -> float | None:
        if below <= rank < below + at_low:
            return b.low
        if rank < below + at_low + between:
            return kept
        return b.high if rank < below + at_low + between + at_high else None

    found = tuple(at(r, v) for r, v in zip((b.lower, b.upper), values if b.between <= limit else (None, None)))
    # A rank was missed, or the two lie on both sides of an end: count the values instead.
    return _by_counts(df, column, b) if None in found else found


def _by_counts(df: DataFrame, column: str, b: Bracket) -> tuple[float, float]:
    """The values of both ranks from the distinct values of a column and a distributed running total."""
    values = df.select(q(column).alias("value")).where("value is not null")
    placed = running_total(values.groupBy("value").count(), "value", "count")
    ends = (
        placed.where((F.col("before") <= b.upper) & (F.col("before") + F.col("count") > b.lower))
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .first()
    )
    return float(ends["low"]), float(ends["high"])


def quantiles(
    df: DataFrame, columns: list[str], fractions: list[float], limit: int = EXACT_VALUES, sketch_k: int = SKETCH_K,
) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolation quantiles of columns of doubles; None for a column without values. Two passes for any number of columns, one
    more for each factor of some seventy that a column has more than ten million values."""
    if not columns:
        return {}
    rows, open_ = first_brackets(df, columns, fractions, sketch_k)
    answers: dict[tuple[str, float], float | None] = {(c, f): None for c in columns for f in fractions}
    while open_:
        keys = list(open_)
        seen = _looked(df, columns, [(c, open_[c, f]) for c, f in keys], limit, sketch_k)
        after = {}
        for (c, f), row in zip(keys, seen):
            found = _answer(df, c, open_[c, f], row, limit, _slack(sketch_k))
            if isinstance(found, Bracket):
                after[c, f] = found
                continue
            position, lower, _ = _position(rows[c], f)
            share = position - lower
            answers[c, f] = float(found[0] + (found[1] - found[0]) * share) if share and found[0] != found[1] else float(found[0])
        open_ = after
    return answers


def grouped_quantile(
    df: DataFrame, by: str, value: str, fraction: float, limit: int = EXACT_VALUES_PER_GROUP
) -> DataFrame:
    """One row per ``by`` group: the group and ``quantile`` (NULL for a group without values)."""
    rows = df.groupBy(q(by)).agg(F.count(q(value)).alias("rows"))
    largest = rows.agg(F.max("rows")).first()[0] or 0
    if largest > limit:
        # Many rows may still be few values. The sketch is a few percent off; half the limit is on the safe side.
        distinct = df.groupBy(q(by)).agg(F.approx_count_distinct(q(value)).alias("n"))
        largest = 2 * distinct.agg(F.max("n")).first()[0]
    if largest <= limit:
        return df.groupBy(q(by)).agg(F.percentile(q(value), fraction).alias("quantile"))

    # A large group: distinct values with their counts, ranked by a running total over value ranges.
    counts = df.where(q(value).isNotNull()).groupBy(q(by), q(value)).count()
    placed = running_total(counts, value, "count", by=[by])
    rows = df.groupBy(q(by).alias("_group")).agg(F.count(q(value)).alias("_rows"))
    position = F.lit(fraction) * (F.col("_rows") - 1)
    lower = F.floor(position)
    upper = F.least(lower + 1, F.col("_rows") - 1)
    last = F.col("before") + F.col("count")
    low = F.min(F.when(last > lower, q(value)))
    high = F.max(F.when(F.col("before") <= upper, q(value)))
    # Inner, with the large side first: only so can a hot group's values be split over tasks. The aggregate combines map-side.
    joined = placed.join(rows, q(by).eqNullSafe(F.col("_group")))
    ends = joined.groupBy("_group", "_rows").agg(low.alias("_low"), high.alias("_high"))
    found = ends.select(F.col("_group").alias("_found"), (F.col("_low") + (F.col("_high") - F.col("_low")) * (position - lower)).alias("quantile"))
    return rows.join(found, F.col("_group").eqNullSafe(F.col("_found")), "left").select(F.col("_group").alias(by), "quantile")
