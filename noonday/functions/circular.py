"""Clock time on a 24-hour circle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MINUTES = 24 * 60


def wrap(minutes: Column) -> Column:
    return F.pmod(minutes, F.lit(float(DAY_MINUTES)))


def clock_distance(a: Column, b: Column) -> Column:
    direct = F.abs(wrap(a) - wrap(b))
    return F.least(direct, F.lit(float(DAY_MINUTES)) - direct)


def angle(minutes: Column) -> Column:
    return wrap(minutes) * F.lit(2 * math.pi / DAY_MINUTES)


def mean_clock(x: Column, y: Column, fallback: Column) -> Column:
    """Minute the summed vector (x, y) points to; the fallback if it has no direction."""
    flat = (F.abs(x) < 1e-9) & (F.abs(y) < 1e-9)
    return F.when(flat, wrap(fallback)).otherwise(wrap(F.atan2(y, x) * F.lit(DAY_MINUTES / (2 * math.pi))))


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def clock_text(minutes: Column) -> Column:
    """``h:mm AM`` of a minute of the day; what rounds up to midnight is the next day's start."""
    m = half_up(wrap(minutes)) % DAY_MINUTES
    hour24 = F.floor(m / 60)
    hour12 = F.when(hour24 % 12 == 0, F.lit(12)).otherwise(hour24 % 12)
    half = F.when(hour24 >= 12, "PM").otherwise("AM")
    return F.concat(hour12.cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), F.lit(" "), half)


def hours_text(hours: Column) -> Column:
    """``H:MM`` of a number of hours; nine decimals first, so that the last digits of a sum do not decide at half a minute."""
    total = F.greatest(F.lit(0), half_up(F.round(hours * 60, 9)))
    return F.concat(F.floor(total / 60).cast("string"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0"))
