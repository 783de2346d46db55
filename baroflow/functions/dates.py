"""Calendar rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from baroflow.functions.nulls import _col


def step_micros(step_minutes: int) -> int:
    return int(step_minutes) * 60_000_000


def floor_div(x: Column, size: int) -> Column:
    """Whole-number quotient rounded down, exact for all 64-bit values."""
    return F.call_function("div", x - F.pmod(x, F.lit(size)), F.lit(size))


def grid_step(time, step_minutes: int = 60) -> Column:
    """Grid position of a reading: its time rounded half up to the step."""
    us = step_micros(step_minutes)
    return floor_div(F.unix_micros(_col(time)) + F.lit(us // 2), us)


def grid_time(step, step_minutes: int = 60) -> Column:
    return F.timestamp_micros(_col(step) * F.lit(step_micros(step_minutes)))


def week_of_year(time) -> Column:
    """Week 1 is 1-7 January whatever the weekday (not the ISO week)."""
    return F.floor((F.dayofyear(_col(time)) - 1) / 7) + 1


def monday_of_week(year, week) -> Column:
    """Date of the Monday of week ``week``; week 1 starts at the year's first Monday.

    Week 0 is the stretch before that Monday.  It maps to the Monday before, except
    in a year that starts on a Monday, where it maps to 1 January.
    """
    y, w = _col(year), _col(week)
    jan1 = F.make_date(y, F.lit(1), F.lit(1))
    first = F.next_day(F.date_sub(jan1, 1), "MON")
    monday = F.date_add(first, ((w - 1) * 7).cast("int"))
    return F.when((w == 0) & (first == jan1), jan1).otherwise(monday)
