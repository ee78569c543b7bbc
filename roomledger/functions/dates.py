"""Calendar expressions, with both weekend conventions in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months treated as peak season.
PEAK_MONTHS = (4, 9, 10, 12)


def dow_sunday0(day: str) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(day) - 1


def dow_monday0(day: str) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(day)


def weekend_fri_sat(day: str) -> Column:
    return (dow_sunday0(day) >= 5).cast("int")


def weekend_fri_sun(day: str) -> Column:
    return (dow_monday0(day) >= 4).cast("int")


def peak_month(day: str) -> Column:
    return F.month(day).isin(*PEAK_MONTHS).cast("int")


def month_start(day: str) -> Column:
    return F.trunc(day, "MM")


def month_label(day: str) -> Column:
    return F.date_format(day, "yyyy-MM")


def days_in_month(day: str | Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def days_since(snapshot: str, day: str | Column) -> Column:
    return F.datediff(F.lit(snapshot).cast("date"), day)
