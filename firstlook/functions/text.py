"""Trimming and column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Every character that counts as white space at the edge of a cell; the last one is U+3000.
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def trim_space(col: Column) -> Column:
    """Trim Unicode white space from both ends; ``trim`` by itself only knows the blank."""
    return F.trim(col, F.lit(SPACE))


def snake_case(name: str) -> str:
    """``SignUp Date`` -> ``sign_up_date``; a name without letters or digits -> ``column``."""
    words = re.findall(r"[0-9a-zA-Z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name))
    return "_".join(words).lower() or "column"


def snake_names(names: list[str]) -> list[str]:
    """Snake-case names; the second and later uses of a name get ``_1``, ``_2``, ..., always unique."""
    uses: dict[str, int] = {}
    result: list[str] = []
    for base in map(snake_case, names):
        name = base
        while name in result:
            uses[base] = uses.get(base, 0) + 1
            name = f"{base}_{uses[base]}"
        result.append(name)
    return result
