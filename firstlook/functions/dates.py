"""Dates from text, elapsed time and period labels, for both Spark timestamp types.

All values are wall-clock ``timestamp_ntz``: nothing here depends on the session time zone.
"""

from __future__ import annotations

from itertools import chain
from typing import Callable

from pyspark.sql import Column, functions as F, types as T

# The date shapes understood besides ISO, and the month names. The years fit a nanosecond clock.
FIRST_YEAR, LAST_YEAR = 1680, 2261
YEAR = r"(1(?:6[89]|[7-9]\d)\d|2(?:[01]\d|2[0-5])\d|226[01])"
NAME = r"([A-Za-z]{3,9})\.?"
DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
WEEKDAY = r"^(?i:(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?),? "
CLOCK = (
    r"[T ]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?|(?<=\d-\d{2}[T ])\d{2})"
    r" ?([AaPp][Mm])?(?: ?(?:Z|UTC|[+-]\d{2}:?\d{2}))?$"
)
YEAR_MONTH_DAY = f"^{YEAR}[-/.](\\d{{1,2}})(?:[-/.](\\d{{1,2}}))?$"
MONTH_DAY_YEAR = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$"
COMPACT = f"^{YEAR}(\\d{{2}})(\\d{{2}})(?:T?(\\d{{2}})(\\d{{2}})(\\d{{2}}))?$"
YEAR_QUARTER = f"^{YEAR}-?[Qq]([1-4])$"
MONTH_YEAR = f"^(\\d{{1,2}})/{YEAR}$"
DAY_NAME_YEAR = f"^{DAY}[- ]?{NAME},?[- ]?{YEAR}$"
NAME_DAY_YEAR = f"^{NAME}[- ]{DAY},?[- ]{YEAR}$"
NAME_YEAR = f"^{NAME}[- ]{YEAR}$"
YEAR_NAME_DAY = f"^{YEAR}[- ]{NAME}(?:[- ]{DAY})?$"
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7,
    "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9,
    "oct": 10, "nov": 11, "dec": 12,
}
# Every shape above starts with a year, a number next to a number or a month name, or a name before a number.
DATE_START = (
    r"^\s*(?:\d{4}(?:$|[Qq\s\d])|\d{1,4}(?:st|nd|rd|th)?[-/.: ]?\s?"
    r"(?:\d|[Qq]\d|(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))"
    r"|(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|mon|tue|wed|thu|fri|sat|sun)[^\n]*\d)"
)

MICROS_PER_DAY = 86_400_000_000


def may_be_date(col: Column) -> Column:
    """Cheap test that every date text passes: it starts like a date."""
    return col.rlike(DATE_START)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_datetime(col: Column) -> Column:
    """Timestamp of a date written in ISO form or one of the shapes above, else NULL.

    Most dates are ISO and need one cast. Other shapes are tested by anchored patterns, so a cell that
    is no date never reaches a parser.
    """
    earliest, latest = (F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz") for year in (FIRST_YEAR, LAST_YEAR + 1))

    def in_any_shape(text: Column) -> Column:
        day_text = F.regexp_replace(F.regexp_replace(text, CLOCK, ""), WEEKDAY, "")
        calendar_day = _bind(day_text, _calendar_day)
        return F.trim(F.concat(calendar_day, F.lit(" "), _time_of_day(text))).try_cast("timestamp_ntz")

    iso_or_other = _bind(
        F.trim(col),
        lambda text: _bind(
            text.try_cast("timestamp_ntz"),
            lambda iso: F.when((iso >= earliest) & (iso < latest), iso).otherwise(in_any_shape(text)),
        ),
    )
    return F.when(may_be_date(col), iso_or_other)


def _calendar_day(text: Column) -> Column:
    """``year-month-day`` of a date text without its time and weekday; NULL for any other text."""
    months = F.create_map(*[F.lit(v) for v in chain.from_iterable(MONTHS.items())])
    one = F.lit("1")

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    def month(pattern: str, group: int) -> Column:
        return F.element_at(months, F.lower(part(pattern, group))).cast("string")

    def day(pattern: str, group: int) -> Column:
        return F.coalesce(F.nullif(part(pattern, group), F.lit("")), one)

    first, second, year = (part(MONTH_DAY_YEAR, g) for g in (1, 2, 3))
    swapped = first.cast("int") > 12
    full_year = F.when(F.length(year) == 4, year).otherwise(
        F.concat(F.when(year.cast("int") >= 70, "19").otherwise("20"), year)
    )
    quarter_start = (part(YEAR_QUARTER, 2).cast("int") * 3 - 2).cast("string")
    shapes = [
        (YEAR_MONTH_DAY, part(YEAR_MONTH_DAY, 1), part(YEAR_MONTH_DAY, 2), day(YEAR_MONTH_DAY, 3)),
        (MONTH_DAY_YEAR, full_year, F.when(swapped, second).otherwise(first), F.when(swapped, first).otherwise(second)),
        (COMPACT, part(COMPACT, 1), part(COMPACT, 2), part(COMPACT, 3)),
        (YEAR_QUARTER, part(YEAR_QUARTER, 1), quarter_start, one),
        (MONTH_YEAR, part(MONTH_YEAR, 2), part(MONTH_YEAR, 1), one),
        (DAY_NAME_YEAR, part(DAY_NAME_YEAR, 3), month(DAY_NAME_YEAR, 2), part(DAY_NAME_YEAR, 1)),
        (NAME_DAY_YEAR, part(NAME_DAY_YEAR, 3), month(NAME_DAY_YEAR, 1), part(NAME_DAY_YEAR, 2)),
        (NAME_YEAR, part(NAME_YEAR, 2), month(NAME_YEAR, 1), one),
        (YEAR_NAME_DAY, part(YEAR_NAME_DAY, 1), month(YEAR_NAME_DAY, 2), day(YEAR_NAME_DAY, 3)),
    ]
    found = F
    for pattern, y, m, d in shapes:
        found = found.when(text.rlike(pattern), F.concat(y, F.lit("-"), m, F.lit("-"), d))
    return found


def _time_of_day(text: Column) -> Column:
    """Time part of a date text on a 24-hour clock, empty when there is none."""
    clock, half = F.regexp_extract(text, CLOCK, 1), F.lower(F.regexp_extract(text, CLOCK, 2))
    hour = F.regexp_extract(clock, r"^\d+", 0).try_cast("int")
    past_hour = F.coalesce(F.nullif(F.regexp_replace(clock, r"^\d+", ""), F.lit("")), F.lit(":00"))
    hour24 = F.when(half == "", hour).when(
        hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0)
    )
    compact = F.regexp_extract(text, r"^\d{8}T?(\d{6})$", 1)
    return F.when(clock != "", F.concat(hour24.cast("string"), past_hour)).otherwise(
        F.regexp_replace(compact, r"(\d{2})(\d{2})(\d{2})", "$1:$2:$3")
    )


def as_datetime(col: Column, dtype: T.DataType) -> Column:
    """Column of any date type, or of date text, as ``timestamp_ntz``."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp_ntz")
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return parse_datetime(col)
    return F.lit(None).cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days of elapsed time, not calendar days."""
    return F.floor(micros_between(start, end) / F.lit(float(MICROS_PER_DAY))).cast("long")


def iso_text(col: Column) -> Column:
    """``2024-01-05T10:11:12``, with six fraction digits only when they are not zero."""
    ts = col.cast("timestamp_ntz")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def period_label(col: Column, kind: str) -> Column:
    """Name of the quarter, month or ISO week a timestamp lies in."""
    if kind == "quarter":
        return F.concat(F.year(col).cast("string"), F.lit("-Q"), F.quarter(col).cast("string"))
    if kind == "month":
        return F.date_format(col, "yyyy-MM")
    week = F.lpad(F.weekofyear(col).cast("string"), 2, "0")
    return F.concat(F.extract(F.lit("YEAROFWEEK"), col).cast("string"), F.lit("-W"), week)
