"""Days, hours and date ranges."""

from __future__ import annotations

from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class DayRange(NamedTuple):
    """A closed range of calendar days."""

    first: date
    last: date


def days_before(as_of: date, oldest: int, newest: int = 1) -> DayRange:
    """The days from ``oldest`` to ``newest`` days before ``as_of``."""
    return DayRange(as_of - timedelta(days=oldest), as_of - timedelta(days=newest))


def single_day(day: date) -> DayRange:
    return DayRange(day, day)


def within(day: Column, days: DayRange) -> Column:
    """``day`` lies in the closed range, compared with literals so that it is pushed down."""
    return day.between(F.lit(days.first), F.lit(days.last))


def hour_start(ts: Column | str) -> Column:
    return F.date_trunc("HOUR", ts)


def hour_label(ts: Column | str) -> Column:
    """``05:00`` for any time in the sixth hour of the day."""
    return F.date_format(ts, "HH:00")


def hour_number(label: Column) -> Column:
    """The hour of an ``HH:00`` label, NULL where the label is not one."""
    return F.substring(label, 1, 2).try_cast("int")
