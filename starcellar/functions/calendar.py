"""Calendar attributes as column expressions over a date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weekend is Friday and Saturday (1 = Sunday in Spark's dayofweek).
WEEKEND_DAYS = (6, 7)


def date_key(day: Column) -> Column:
    """Integer key ``yyyyMMdd``."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.day(day)).cast("int")


def week_number(day: Column) -> Column:
    """Week of the year where week 1 holds 1 January and weeks start on Sunday (not ISO weeks)."""
    days_before_first = F.dayofweek(F.trunc(day, "YEAR")) - 1
    return (F.floor((F.dayofyear(day) - 1 + days_before_first) / 7) + 1).cast("int")


def period_label(day: Column) -> Column:
    """``January 2016``."""
    return F.concat_ws(" ", F.date_format(day, "MMMM"), F.year(day).cast("string"))


ATTRIBUTES = {
    "DateKey": date_key,
    "FullDate": lambda day: day,
    "DayNumber": F.day,
    "DayName": lambda day: F.date_format(day, "EEEE"),
    "MonthNumber": F.month,
    "MonthName": lambda day: F.date_format(day, "MMMM"),
    "QuarterNumber": F.quarter,
    "QuarterName": lambda day: F.concat(F.lit("Q"), F.quarter(day)),
    "YearNumber": F.year,
    "MonthYear": lambda day: F.date_format(day, "yyyy-MMM"),
    "WeekNumber": week_number,
    "IsWeekend": lambda day: F.dayofweek(day).isin(*WEEKEND_DAYS),
}


def calendar_columns(day: Column, names: list[str] | None = None) -> list[Column]:
    """The named calendar attributes of ``day`` (all by default)."""
    return [ATTRIBUTES[name](day).alias(name) for name in names or ATTRIBUTES]


def year_range(year: int) -> tuple[dt.date, dt.date]:
    """First day of the year, and of the next one."""
    return dt.date(year, 1, 1), dt.date(year + 1, 1, 1)


def month_range(year: int, month: int) -> tuple[dt.date, dt.date]:
    """First day of the month, and of the next one."""
    following = dt.date(year + month // 12, month % 12 + 1, 1)
    return dt.date(year, month, 1), following


def previous_month(today: dt.date) -> tuple[int, int]:
    """Year and month before the month of ``today``: the period a monthly report covers by default."""
    last = today.replace(day=1) - dt.timedelta(days=1)
    return last.year, last.month
