"""Small helpers over columns and physical types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL_TYPES = (T.FloatType, T.DoubleType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
TEXT_TYPES = (T.StringType, T.VarcharType, T.CharType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)

# Fixed value: optional sign, digits with an optional fraction and exponent, or infinity.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def q(name: str) -> Column:
    """Column by its literal name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have, also not in another case, for a column that comes and goes."""
    taken, name = {c.lower() for c in df.columns}, wanted
    while name.lower() in taken:
        name += "_"
    return name


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, NESTED_TYPES)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one kind of missing value everywhere in this package; an untyped column is a number."""
    return df.select(
        *[
            F.nanvl(q(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, REAL_TYPES)
            else q(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.NullType)
            else q(f.name)
            for f in df.schema
        ]
    )


def is_number_text(col: Column) -> Column:
    return col.rlike(NUMBER_PATTERN)


def as_number(col: Column, dtype: T.DataType) -> Column:
    """Value as a double; text that is not a number, NaN and non-numeric types become NULL."""
    if isinstance(dtype, TEXT_TYPES):
        return F.when(is_number_text(col), F.trim(col).try_cast("double"))
    if isinstance(dtype, REAL_TYPES):
        value = col.cast("double")
        return F.nanvl(value, F.lit(None).cast("double"))
    if isinstance(dtype, WHOLE_TYPES) or isinstance(dtype, (T.DecimalType, T.BooleanType)):
        return col.cast("double")
    return F.lit(None).cast("double")


def numbers(df: DataFrame, names: list[str]) -> list[Column]:
    """The named columns as doubles, under their own names."""
    return [as_number(q(n), data_type(df, n)).alias(n) for n in names]


def as_label(col: Column, dtype: T.DataType) -> Column:
    """Text form of a category value; booleans print as True and False."""
    if isinstance(dtype, T.BooleanType):
        return F.initcap(col.cast("string"))
    if isinstance(dtype, TIME_TYPES):
        from .dates import iso_text

        return iso_text(col)
    return col.cast("string")
