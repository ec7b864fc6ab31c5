"""Months, contract years and dates of cells."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(date: Column) -> Column:
    return F.trunc(date, "month")


def month_ordinal(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def contract_year(date: Column, as_of: dt.date) -> Column:
    """CYn: the year that ends on as_of's day; dates up to that day belong to the year before."""
    early = (F.month(date) < as_of.month) | ((F.month(date) == as_of.month) & (F.day(date) <= as_of.day))
    return F.concat(F.lit("CY"), (F.year(date) - F.when(early, 1).otherwise(0)).cast("string"))


def year_floor(as_of: dt.date, years: int) -> dt.date:
    """as_of some years earlier; 29 February becomes the 28th."""
    day = 28 if (as_of.month, as_of.day) == (2, 29) else as_of.day
    return dt.date(as_of.year - years, as_of.month, day)


def month_before(date: Column) -> Column:
    """The same day one month earlier, clamped to that month."""
    return F.add_months(date, -1)


def days_in_month(date: Column) -> Column:
    return F.day(F.last_day(date))


def cell_date(mon: Column, cy: Column, as_of: dt.date) -> Column:
    """The day that stands for a (month, contract year) cell, clamped to the month."""
    ends_here = (F.month(mon) == as_of.month) & (F.right(cy, F.lit(4)).cast("int") == F.year(mon) - 1)
    day = F.least(F.when(ends_here, as_of.day).otherwise(as_of.day + 1), days_in_month(mon))
    return F.make_date(F.year(mon), F.month(mon), day)
