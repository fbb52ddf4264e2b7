"""Calendar expressions. All of them work on DATE columns and stay inside generated code."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_cutoff(value: int | str | date) -> date:
    """The cut-off as a date: a date, ISO text, or the warehouse's (year - 1900)MMDD integer."""
    if isinstance(value, date):
        return value
    if isinstance(value, str):
        return date.fromisoformat(value)
    return date(value // 10000 + 1900, value // 100 % 100, value % 100)


def date_of_code(code: Column) -> Column:
    """Decode a column of (year - 1900)MMDD integers."""
    return F.make_date(
        F.floor(code / 10000).cast("int") + 1900,
        F.pmod(F.floor(code / 100), F.lit(100)).cast("int"),
        F.pmod(code, F.lit(100)).cast("int"),
    )


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_end(day: Column) -> Column:
    return F.last_day(day)


def days_on(start: Column, end: Column, as_of: date | Column) -> Column:
    """Days from ``start`` to ``end``; a line that has not ended counts up to ``as_of``."""
    until = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.datediff(F.coalesce(end, until), start)


def day_block(day: Column, width: int) -> Column:
    """Number of the ``width``-day block a date lies in (monotone in the date)."""
    return F.floor(F.unix_date(day) / F.lit(width)).cast("int")
