"""Date helpers: lookback bounds and day-first date text."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from navframe import params as P


def as_of_col(as_of=None) -> Column:
    """The reference date as a column: a date literal, or ``current_date()``."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of).cast("date")


def lookback_start(as_of=None, months: int = P.LOOKBACK_MONTHS) -> Column:
    """``as_of`` minus ``months`` calendar months (end-of-month clamped)."""
    return F.add_months(as_of_col(as_of), -int(months))


def parse_day_first(text, strict: bool = True, fmt: str = P.NAV_DATE_FORMAT) -> Column:
    """Day-month-year text to a date.

    ``strict`` raises on a bad value (ANSI ``to_date``); otherwise the value
    becomes NULL so the caller can route the row to quarantine.
    """
    c = F.col(text) if isinstance(text, str) else text
    return F.to_date(c, fmt) if strict else F.try_to_date(c, fmt)


def format_day_first(date, fmt: str = "dd-MM-yyyy") -> Column:
    c = F.col(date) if isinstance(date, str) else date
    return F.date_format(c, fmt)
