"""Row order on a distributed table.

A window over a whole table puts every row in one task. Here the order column is cut into many
ranges ("chunks"); windows run inside each chunk, and one small row per chunk carries totals or
last values from the chunks before it. The number of chunks follows the shuffle setting, so the
chunk table stays small however many rows there are, and one hot group is spread over many chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import REAL_TYPES, WHOLE_TYPES, data_type, free_name, q
from ..functions.dates import micros_between
from .reuse import is_small
from .written import written

CHUNK = "_chunk"
MAX_CHUNKS = 20_000


def chunk_count(df: DataFrame) -> int:
    """One chunk per shuffle partition, within fixed limits."""
    return min(MAX_CHUNKS, max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _order_position(df: DataFrame, order_by: str) -> Column:
    """The order column on a number line; equal or rising wherever the column rises."""
    dtype, col = data_type(df, order_by), q(order_by)
    if isinstance(dtype, WHOLE_TYPES + REAL_TYPES + (T.DecimalType,)):
        return col.cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return micros_between(epoch, col.cast("timestamp_ntz")).cast("double")
    raise ValueError(
        f"order column '{order_by}' must be a number, a date or the source order, not {dtype.simpleString()}"
    )


def is_source_order(df: DataFrame, order_by: str) -> bool:
    dtype = data_type(df, order_by)
    return isinstance(dtype, T.StructType) and dtype.fieldNames()[:2] == ["file", "block"]


def add_chunk(df: DataFrame, order_by: str, chunks: int | None = None, name: str = CHUNK) -> DataFrame:
    """Add the chunk a row belongs to, under a ``name`` of its own. Chunks rise with ``order_by`` and hold similar row counts.

    Rows read from files keep the file split they came from. Otherwise the cuts are approximate
    quantiles; any cut gives the same results, so that only touches the balance. Rows without a place are in the last chunk, whose number is
    that of the chunks asked for at most.
    """
    if is_source_order(df, order_by):
        return df.withColumn(name, F.struct(q(order_by)["file"], q(order_by)["block"]))
    wanted, position = chunks or chunk_count(df), free_name(df, "_position")
    placed = df.withColumn(position, _order_position(df, order_by))
    cuts = _cuts(placed.select(position), wanted)
    if not cuts:  # no rows, or one chunk
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=position, outputCol=name, handleInvalid="keep").transform(placed)
    return bucketed.drop(position).withColumn(name, F.col(name).cast("int"))


def _cuts(positions: DataFrame, wanted: int) -> list[float]:
    """Rising cut points, from one pass that merges a sketch of each task."""
    if wanted < 2:
        return []
    fractions = [i / wanted for i in range(1, wanted)]
    cuts = positions.agg(F.percentile_approx(positions.columns[0], fractions, max(1_000, 4 * wanted))).first()[0]
    return sorted(set(cuts or []))


def running_total(
    df: DataFrame, order_by: str, value: str, by: list[str] | None = None, output: str = "before"
) -> DataFrame:
    """Add, per ``by`` group, the sum of ``value`` over all rows ordered before the row.

    ``df`` must have one row per (group, order value), e.g. after ``groupBy(...).count()``. It is read
    several times, so unless it is small it is written out once first.
    """
    by = by or []
    df = df if is_small(df) else written(df)
    chunk, total, inside, in_chunk, carried = (free_name(df, n) for n in (CHUNK, "_total", "_inside", "_in_chunk", "_carried"))
    groups = [free_name(df, f"_by{i}") for i in range(len(by))]
    chunked = add_chunk(df, order_by, name=chunk)
    keys = [q(c) for c in by]
    totals = chunked.groupBy(*keys, q(chunk)).agg(F.sum(q(value)).alias(total))
    earlier = Window.partitionBy(*keys).orderBy(q(chunk)).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *[k.alias(g) for k, g in zip(keys, groups)],
        q(chunk).alias(in_chunk),
        F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(carried),
    )
    match = q(chunk).eqNullSafe(q(in_chunk))
    for k, g in zip(keys, groups):
        match = match & k.eqNullSafe(q(g))
    upto = Window.partitionBy(*keys, q(chunk)).orderBy(q(order_by)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunked.withColumn(inside, F.coalesce(F.sum(q(value)).over(upto), F.lit(0)))
        .join(before, match)
        .select(*[q(c) for c in df.columns], (q(inside) + q(carried)).alias(output))
    )


class OrderError(ValueError):
    """Rows have no order: a place is missing or taken twice."""


def fill_in_order(df: DataFrame, columns: list[str], order_by: str, checked: bool = False) -> DataFrame:
    """Forward-fill ``columns`` in row order; leading NULLs take the first value that follows.

    Three passes: one over the order alone finds the cuts; one over the order and the filled columns gives one row for each chunk, its last
    and first known values; the last one deals the whole rows into their chunks, where a window fills them.
    ``checked`` looks in the second pass, in its sort, whether each row has a place of its own.
    """
    if not columns:
        return df
    chunk, in_chunk = free_name(df, CHUNK), free_name(df, "_in_chunk")
    seen_as, carried_as = ([free_name(df, f"{kind}{i}") for i in range(len(columns))] for kind in ("_seen", "_carried"))
    order, chunks = q(order_by), chunk_count(df)
    chunked = add_chunk(df, order_by, chunks, name=chunk)
    by_file = is_source_order(df, order_by)
    # Ranges are dealt to tasks by their number; the last number is that of rows without a place.
    dealt = (lambda t: t) if by_file else (lambda t: t.repartitionById(chunks + 1, q(chunk)))

    ends = _ends(chunked, dealt, columns, order_by, chunk, checked)
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    anywhere = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select(
        F.col("chunk").alias(in_chunk),
        *[
            F.coalesce(
                F.last(f"last{i}", ignorenulls=True).over(before),
                F.first(f"first{i}", ignorenulls=True).over(anywhere),
            ).alias(carried_as[i])
            for i in range(len(columns))
        ],
    )
    upto = Window.partitionBy(chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt(chunked).withColumns({seen_as[i]: F.last(q(n), ignorenulls=True).over(upto) for i, n in enumerate(columns)})
    place = {n: i for i, n in enumerate(columns)}
    return seen.join(carried, q(chunk).eqNullSafe(F.col(in_chunk))).select(
        *[
            F.coalesce(F.col(seen_as[place[n]]), F.col(carried_as[place[n]])).alias(n) if n in place else q(n)
            for n in df.columns
        ]
    )


def _ends(
    chunked: DataFrame, dealt: Callable[[DataFrame], DataFrame], columns: list[str], order_by: str, chunk: str, checked: bool
) -> DataFrame:
    """(chunk, last0, first0, ...): one row for each chunk. Those of ranges, which are no more than the shuffle has partitions, come by way of the driver."""
    narrow = chunked.select(q(chunk).alias("chunk"), q(order_by).alias("place"), *[q(n).alias(f"v{i}") for i, n in enumerate(columns)])
    known = []
    for i in range(len(columns)):
        at = F.when(F.col(f"v{i}").isNotNull(), F.col("place"))
        known += [F.max_by(f"v{i}", at).alias(f"last{i}"), F.min_by(f"v{i}", at).alias(f"first{i}")]
    if not checked:
        return narrow.groupBy("chunk").agg(*known)
    earlier = F.lag("place").over(Window.partitionBy("chunk").orderBy("place"))
    marked = dealt(narrow.withColumnRenamed("chunk", chunk)).withColumnRenamed(chunk, "chunk").withColumn("again", F.col("place") == earlier)
    missing = F.col("place").isNull() | (F.isnan("place") if isinstance(data_type(narrow, "place"), REAL_TYPES) else F.lit(False))
    ends = marked.groupBy("chunk").agg(*known, F.max("again").alias("again"), F.max(missing).alias("missing"))
    rows = ends.collect()
    if any(r["missing"] for r in rows):
        raise OrderError(f"the order column '{order_by}' has missing values")
    if any(r["again"] for r in rows):
        raise OrderError(f"the order column '{order_by}' repeats values")
    spark = chunked.sparkSession
    return spark.createDataFrame([tuple(r)[:-2] for r in rows], T.StructType(ends.schema.fields[:-2]))


def numbered(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Add ``position``, from 0 on in the order of the keys: a distributed sort, then row numbers from per-partition counts."""
    rows = written(df.orderBy(*keys).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).select("_part", "_before")
    placed = rows.withColumn("_part", part).join(before, "_part")
    return placed.withColumn("position", F.col("_before") + F.col("_place") % F.lit(1 << 33)).drop("_part", "_before", "_place")
