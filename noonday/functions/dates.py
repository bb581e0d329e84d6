"""Dates, clock times and offsets as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
# A clinical day runs noon to noon; UTC offsets reach from -14 h to +14 h.
CLINICAL_CUTOFF_HOURS = 12
MAX_OFFSET_MINUTES = 14 * 60


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    return F.unix_micros(_col(ts))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(60 * MICROS)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(MICROS)


def shift_seconds(ts: Column | str, seconds: Column | int) -> Column:
    amount = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(micros(ts) + amount.cast("bigint") * F.lit(MICROS))


def shift_minutes(ts: Column | str, minutes: Column | int) -> Column:
    amount = F.lit(minutes) if isinstance(minutes, int) else minutes
    return shift_seconds(ts, amount.cast("bigint") * 60)


def clinical_day(ts: Column | str) -> Column:
    """Start date of the noon-to-noon day that holds ``ts``."""
    return F.to_date(_col(ts) - F.expr(f"INTERVAL {CLINICAL_CUTOFF_HOURS} HOURS"))


def minute_of_day(ts: Column | str) -> Column:
    """Minutes since midnight, with whole seconds as a fraction."""
    c = _col(ts)
    return F.hour(c) * 60 + F.minute(c) + F.floor(F.second(c)) / 60


def strict_date(year: Column, month: Column, day: Column) -> Column:
    """Date from digit groups; NULL for an empty group, a day that does not exist, or a year outside 1900-2100."""
    text = F.concat_ws("-", year, month, day)
    date = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.year(date).between(1900, 2100), date)


# The date-time shapes looked for anywhere in a text.
ISO_DATETIME = r"(\d{4})-(\d{2})-(\d{2})[ T](\d{1,2}):(\d{2})(?::(\d{2}))?"
US_DATETIME = r"(\d{2})/(\d{2})/(\d{4})[ T](\d{1,2}):(\d{2})(?::(\d{2}))?"
ISO_DATE = r"(\d{4})-(\d{2})-(\d{2})"
US_DATE = r"(\d{2})/(\d{2})/(\d{4})"
# In the order in which they are tried, with the order of their date's parts.
SHAPES = ((ISO_DATETIME, "ymd"), (US_DATETIME, "mdy"), (ISO_DATE, "ymd"), (US_DATE, "mdy"))


def _stamp(parts: Column, order: str) -> Column:
    """Time from the number texts of a date, whose parts come in ``order``, and of the clock; noon without a clock."""
    year, month, day = (F.get(parts, F.lit(order.index(x))) for x in "ymd")
    hour, minute = F.coalesce(F.get(parts, F.lit(3)), F.lit("12")), F.coalesce(F.get(parts, F.lit(4)), F.lit("00"))
    second = F.coalesce(F.get(parts, F.lit(5)), F.lit("00"))
    text = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), F.lpad(hour, 2, "0"), F.lit(":"), minute, F.lit(":"), second)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def parse_datetime(text: Column | str) -> Column:
    """First ISO or US date-time in a text, else the first date at noon; NULL for impossible dates.

    Each shape is looked for once, and only if the shapes before it gave no time; what it finds is split at its signs.
    """
    c = _col(text)

    def read(shape: str, order: str) -> Column:
        found = F.regexp_extract(c, shape, 0)
        # a one-element array names the match, so that it is not looked for again for each of its parts
        return F.get(F.transform(F.array(found), lambda m: F.when(m != "", _stamp(F.split(m, "[-/ T:]"), order))), F.lit(0))

    return F.coalesce(*[read(*shape) for shape in SHAPES])


_SHAPES = tuple((re.compile(shape, re.ASCII), order) for shape, order in SHAPES)


def _month_days(year: int, month: int) -> int:
    if month == 2:
        return 29 if year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else 28
    return 30 if month in (4, 6, 9, 11) else 31


def wall_clock(text: str) -> str | None:
    """What ``parse_datetime`` reads in a text, for readers of whole texts in Python: a text that casts to the time."""
    for shape, order in _SHAPES:
        found = shape.search(text)
        if not found:
            continue
        date, clock = dict(zip(order, found.groups(), strict=False)), found.groups()[3:] or ("12", "00", "00")
        hour, minute, second = clock[0].zfill(2), clock[1], clock[2] or "00"
        month = int(date["m"])
        if 1 <= month <= 12 and 1 <= int(date["d"]) <= _month_days(int(date["y"]), month) and hour < "24" and minute < "60" and second < "60":
            return f"{date['y']}-{date['m']}-{date['d']} {hour}:{minute}:{second}"
    return None


def valid_offset(minutes: Column) -> Column:
    return F.when(minutes.between(-MAX_OFFSET_MINUTES, MAX_OFFSET_MINUTES), minutes.cast("bigint"))


def parse_utc_offset(text: Column | str) -> Column:
    """Minutes east of UTC from ``Z``, ``UTC``, ``+2``, ``-05:30``, ``GMT+0130``; NULL if not an offset."""
    compact = F.regexp_replace(F.trim(_col(text)), r"\s+", "")
    bare = F.regexp_replace(compact, r"(?i)^(?:utc|gmt)(?=[+-].)", "")
    # A second prefix is looked for as well, so "UTCGMT+1" reads as +1.
    sign = F.when(F.substring(bare, 1, 1) == "-", -1).otherwise(1)
    hours = F.regexp_extract(bare, r"^[+-](\d{1,2})(?::?(\d{2}))?$", 1)
    mins = F.regexp_extract(bare, r"^[+-](\d{1,2})(?::?(\d{2}))?$", 2)
    minute_part = F.when(mins == "", F.lit(0)).otherwise(mins.try_cast("int"))
    value = F.when(minute_part < 60, sign * (hours.try_cast("int") * 60 + minute_part))
    return F.when(F.lower(compact).isin("z", "utc", "gmt"), F.lit(0).cast("bigint")).otherwise(valid_offset(value))


def local_noon(ts: Column | str, offset_minutes: Column) -> Column:
    """Noon of the calendar day that ``ts`` falls on at the offset."""
    return F.date_trunc("day", shift_minutes(ts, valid_offset(offset_minutes))) + F.expr("INTERVAL 12 HOURS")


def packed_date(word: Column, year_base: int, year_shift: int, month_shift: int) -> Column:
    """Date from bit fields of one word: year above ``year_shift``, 4 bits of month, 5 bits of day."""
    year = F.shiftright(word, year_shift) + year_base
    month = F.shiftright(word, month_shift).bitwiseAND(F.lit(15))
    day = word.bitwiseAND(F.lit(31))
    return strict_date(
        year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")
    )


def edf_datetime(date: Column | str, time: Column | str) -> Column:
    """Start of an EDF recording from ``dd.mm.yy`` and ``hh.mm.ss``; years 70-99 are 19xx; no time means noon."""
    d, t = _col(date), _col(time)
    day, month, yy = (F.regexp_extract(d, r"^(\d{2})\.(\d{2})\.(\d{2})$", i) for i in (1, 2, 3))
    year = F.when(yy.try_cast("int") >= 70, F.concat(F.lit("19"), yy)).otherwise(F.concat(F.lit("20"), yy))
    h, m, s = (F.regexp_extract(t, r"^(\d{2})[.:](\d{2})[.:](\d{2})$", i) for i in (1, 2, 3))
    clock = F.when(h == "", F.lit("12:00:00")).otherwise(F.concat_ws(":", h, m, s))
    return F.when(
        day != "", F.try_to_timestamp(F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), clock),
                                      F.lit("yyyy-MM-dd HH:mm:ss"))
    )


def timestamp_from_parts(year_base: int, year: Column, month: Column, day: Column, hour: Column,
                         minute: Column, second: Column) -> Column:
    """Timestamp from byte parts with a base year; NULL if any part is out of range."""
    parts = [F.lpad(c.cast("string"), 2, "0") for c in (month, day, hour, minute, second)]
    ok = (month.between(1, 12) & day.between(1, 31) & hour.between(0, 23) & minute.between(0, 59)
          & second.between(0, 59))
    mo, d, h, mi, s = parts
    text = F.concat((year + year_base).cast("string"), F.lit("-"), mo, F.lit("-"), d, F.lit(" "), h,
                    F.lit(":"), mi, F.lit(":"), s)
    return F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def timestamp_from_epoch(seconds: Column, offset_seconds: int = 0) -> Column:
    """Timestamp of positive epoch seconds counted from a shifted epoch."""
    return F.when(seconds > 0, F.timestamp_seconds(seconds + offset_seconds))


def human_date(date: Column | str) -> Column:
    return F.date_format(_col(date), "MMMM d, yyyy")


# Age limits in days of the staleness classes.
STALE_NOTICE_DAYS, STALE_WARNING_DAYS, STALE_CRITICAL_DAYS = 7, 30, 90


def staleness(days: Column) -> Column:
    return (
        F.when(days > STALE_CRITICAL_DAYS, "critical")
        .when(days > STALE_WARNING_DAYS, "warning")
        .when(days > STALE_NOTICE_DAYS, "notice")
    )
