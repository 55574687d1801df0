"""Calendar arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year, by the anonymous integer algorithm."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    weekday = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * weekday, 451)
    n = h + weekday - 7 * m + 114
    return F.make_date(year, div(n, 31), n % 31 + 1)


def iso_monday(year: Column, week: Column) -> Column:
    """Monday of an ISO week."""
    return F.date_add(F.trunc(F.make_date(year.cast("int"), F.lit(1), F.lit(4)), "week"), ((week - 1) * 7).cast("int"))


def month_start(year: Column, month: Column) -> Column:
    """First day of a month; null if either part is null."""
    return F.when(year.isNotNull() & month.isNotNull(), F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))
