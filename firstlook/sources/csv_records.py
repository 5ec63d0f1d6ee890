"""Records of CSV files whose quoted cells hold line breaks, found without reading a file in one task.

A text scan splits files anywhere and gives lines. Whether a line begins a record depends on whether the lines before it end inside a quoted cell. A line
does one of three things to that state, whatever it was: it leaves it, sets it, or turns it round; patterns tell which, for both states that a line
may begin in. Effects of following lines add up to an effect again, so each file split is summed up alone, a running total over one row for
each split gives the state in which each of them begins. Records are then put together where their lines were read; only what lies on either side of
the end of a split is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.written import written
from .order import ROW_ORDER, file_order

# A cell opens with a quote only at its start; after the closing quote, text runs on up to the comma. Possessive, so that no text is too long for them.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_CELLS = rf'(?>(?:"{_QUOTED}"(?!")[^,]*+|[^",][^,]*+)?+,)*+'
_ENDS_INSIDE = rf'{_CELLS}"{_QUOTED}\z'
_STAYS_INSIDE = rf'(?:{_QUOTED}\z|{_QUOTED}"(?!")[^,]*+,{_ENDS_INSIDE})'

EFFECTS = "file string, block long, outside boolean, inside boolean, begins boolean, bytes long"
RECORDS = "value string, file string, block long, row long, head long"
TASK_BYTES = 32 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, row order) of all lines."""
    return spark.read.option("lineSep", "\n").text(path).select("value", file_order())


def opens(value: Column) -> Column:
    """Whether a line that begins a record ends inside a quoted cell."""
    return value.contains('"') & value.rlike("^" + _ENDS_INSIDE)


def _stays(value: Column) -> Column:
    """Whether a line that begins inside a quoted cell ends inside one."""
    return ~value.contains('"') | value.rlike("^" + _STAYS_INSIDE)


def _splits_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The lines of each split in a batch; a split may go on in the next one."""
    file, block = batch["file"].dictionary_encode().indices.to_numpy(), batch["block"].to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
        if b > a:
            yield (batch["file"][a].as_py(), batch["block"][a].as_py()), batch.slice(a, b - a)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of EFFECTS: the state after a split that begins outside a quoted cell and after one that begins inside, whether a record begins in the latter, and bytes."""
    at, rows = None, []
    for batch in batches:
        for split, lines in _splits_of(batch):
            if split != at:
                at = split
                rows.append([*split, False, True, False, 0])
            outside, inside, begins, size = rows[-1][2:]
            for opens_, stays in zip(lines["opens"].to_pylist(), lines["stays"].to_pylist()):
                begins |= not inside
                outside, inside = stays if outside else opens_, stays if inside else opens_
            rows[-1][2:] = outside, inside, begins, size + sum(lines["bytes"].to_pylist())
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["file", "block", "outside", "inside", "begins", "bytes"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RECORDS: whole records, and of one that goes on in another split the lines in each, with the block that it begins in as head."""
    at, inside, head, first, held, rows = None, False, None, 0, [], []

    def put(head: int | None) -> None:
        rows.append(("\n".join(held), *at, first, head))
        held.clear()

    def given() -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["value", "file", "block", "row", "head"])
        rows.clear()
        return batch

    for batch in batches:
        for split, lines in _splits_of(batch):
            if split != at:
                if held:
                    put(at[1] if head is None else head)
                at, head = split, lines["carried"][0].as_py()
                inside = head is not None
            for value, row, opens_, stays in zip(*(lines[c].to_pylist() for c in ("value", "row", "opens", "stays"))):
                if not held:
                    first = row
                held.append(value)
                inside = stays if inside else opens_
                if not inside:
                    put(head)
                    head = None
        yield given()
    if held:
        put(at[1] if head is None else head)
        yield given()


def find_records(lines: DataFrame) -> tuple[DataFrame, int]:
    """(value, row order) of all records, those of several lines with the order of their first one; and how many files end inside a quoted cell.

    Takes lines as the scan gives them: the lines of a split in one task, in order. Records are written once, if no file ends inside a quoted cell.
    """
    place = F.col(ROW_ORDER)
    at = ["file", "block"]
    judged = lines.select("value", F.octet_length("value").alias("bytes"), place["file"].alias("file"), place["block"].alias("block"), place["row"].alias("row"), opens(F.col("value")).alias("opens"), _stays(F.col("value")).alias("stays"))
    splits = judged.select(*at, "bytes", "opens", "stays").mapInArrow(_effects, EFFECTS)

    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = F.sum((F.col("outside") & ~F.col("inside")).cast("long")).over(along).bitwiseAND(F.lit(1))
    # Where a split sets the state, the state if no turn had been made; it holds until the next such split.
    sets = F.when(F.col("outside") == F.col("inside"), F.col("outside").cast("long").bitwiseXOR(F.col("turns")))
    after = F.coalesce(F.last(sets, ignorenulls=True).over(along), F.lit(0)).bitwiseXOR(F.col("turns"))
    by_block = Window.partitionBy("file").orderBy("block")
    states = written(splits.withColumn("turns", turns).withColumn("after", after).withColumn("before", F.lag("after", 1, 0).over(by_block)))
    files = states.groupBy("file").agg(F.max_by("after", "block").alias("after"), F.sum("bytes").alias("bytes"))
    open_files, size = (x or 0 for x in files.agg(F.sum("after"), F.sum("bytes")).first())
    if open_files:
        return lines, open_files

    # The block in which the record begins that a split goes on with.
    begun = F.when((F.col("before") == 0) | F.col("begins"), F.col("block"))
    carried = states.withColumn("carried", F.last(begun, ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1))).filter("before = 1")
    # A broadcast, whatever its size (a row for each split), since a shuffle would part the lines of splits.
    told = judged.join(F.broadcast(carried.select(*at, "carried")), at, "left").select("value", *at, "row", "opens", "stays", "carried")
    # Many small splits are read one after another, so that not every one makes a file.
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    found = written(told.coalesce(tasks).mapInArrow(_records, RECORDS))
    order = F.struct(*at, "row").alias(ROW_ORDER)
    parts = found.filter("head IS NOT NULL").groupBy("file", "head").agg(F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("lines"), F.min(order).alias(ROW_ORDER))
    gathered = written(parts.select(F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"), ROW_ORDER))
    return found.filter("head IS NULL").select("value", order).union(gathered), 0
