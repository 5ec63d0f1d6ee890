"""The row order of a table read from files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Technical column that remembers the source order; it is not data and never reported.
ROW_ORDER = "_row"


def file_order() -> Column:
    """(file, block, row): sorts rows of a file scan as they stand in the files."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).alias(ROW_ORDER)
