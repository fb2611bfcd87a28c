"""Capture dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capture_date(c: Column) -> Column:
    """Date of eight digits; NULL for other texts and for days that do not exist."""
    return F.when(c.rlike("^[0-9]{8}$"), F.try_to_date(c, "yyyyMMdd"))


def middle_of(year: Column) -> Column:
    """The day that stands for a year: 1 July."""
    return F.make_date(year, F.lit(7), F.lit(1))


def day_distance(day: Column, year: Column) -> Column:
    return F.abs(F.datediff(day, middle_of(year)))


def capture_text(day: Column) -> Column:
    return F.date_format(day, "d MMM yyyy")


def capture_kind(day: Column, year: Column, provisional: Column) -> Column:
    return F.when(provisional, "provisional").when(F.year(day) == year, "same year").otherwise("other year")
