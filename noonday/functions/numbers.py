"""Numbers out of text, unit normalisation and number formatting as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matched_number(text: Column, pattern: str) -> Column:
    """First number that group 1 of a pattern finds in a text, NULL without one.

    A match that is not there is NULL, not an empty text: the cast of an empty text costs a Java exception.
    """
    return F.get(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(0)).try_cast("double")


LEADING_NUMBER = r"^([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def safe_number(text: Column | str) -> Column:
    """Leading number of a text after commas are taken out; NULL if it does not start with one."""
    bare = F.trim(F.replace(_col(text), F.lit(","), F.lit("")))
    return matched_number(bare, LEADING_NUMBER)


_LEADING_NUMBER = re.compile(LEADING_NUMBER, re.ASCII)


def leading_number(text: str) -> float | None:
    """``safe_number`` for readers of whole texts in Python."""
    found = _LEADING_NUMBER.match(text.replace(",", "").strip(" "))
    return float(found[1]) if found else None


def first_number(text: Column | str) -> Column:
    """Leading number, else the first number anywhere in the text."""
    return F.coalesce(safe_number(text), setting_number(text))


def norm_pressure(value: Column | str) -> Column:
    """cmH2O: 0-80 as it is, up to 8000 in hundredths, else NULL."""
    v = _col(value)
    return F.when((v >= 0) & (v <= 80), v).when((v > 80) & (v <= 8000), v / 100)


def pressure(value: float | None) -> float | None:
    """``norm_pressure`` for readers of whole texts in Python."""
    if value is None or not 0 <= value <= 8000:
        return None
    return value if value <= 80 else value / 100


def norm_tidal_volume_ml(value: Column | str, unit: Column | str) -> Column:
    """Millilitres by unit word, a bare number up to 5 being litres; NULL outside 20-5000."""
    v, text = _col(value), F.lower(F.coalesce(_col(unit), F.lit("")))
    ml_word = text.rlike(r"\b(?:ml|milliliter|millilitre|milliliters|millilitres)\b")
    litre_word = text.rlike(r"\b(?:l|liter|litre|liters|litres)\b")
    ml = F.when(~ml_word & (litre_word | (v <= 5)), v * 1000).otherwise(v)
    return F.when((v > 0) & ml.between(20, 5000), ml)


# Unit spellings.
PER_MINUTE_UNIT = r"^(?:l/m|l/min|lpm|l/minute|l/minutes)$"
PER_SECOND_UNIT = r"^(?:l/s|lps|l/sec|l/second|l/seconds)$"
MINUTES_UNIT = r"^min\.?(?:ute)?s?$"
SECONDS_UNIT = r"^sec\.?(?:ond)?s?$"
HOURS_UNIT = r"^(?:h|hr|hrs|hour|hours)$"


def norm_leak_lpm(value: Column | str, unit: Column | str, assume_per_second: bool = False) -> Column:
    """Litres per minute: times 60 for a per-second unit, or for an unknown unit if that is assumed."""
    v = _col(value)
    text = F.lower(F.regexp_replace(F.coalesce(_col(unit), F.lit("")), r"[\s.]+", ""))
    times_60 = text.rlike(PER_SECOND_UNIT) | F.lit(assume_per_second)
    return F.when(text.rlike(PER_MINUTE_UNIT), v).when(times_60, v * 60).otherwise(v)


def norm_usage_hours(value: Column | str, unit: Column | str) -> Column:
    """Hours by unit word; without one up to 24 are hours and up to 1440 minutes.  More than a day is NULL."""
    v = _col(value)
    text = F.lower(F.trim(F.coalesce(_col(unit), F.lit(""))))
    hours = (
        F.when(text.rlike(MINUTES_UNIT), v / 60)
        .when(text.rlike(SECONDS_UNIT), v / 3600)
        .when(text.rlike(HOURS_UNIT) | (v <= 24), v)
        .otherwise(v / 60)
    )
    return F.when(hours.between(0, 24), hours)


def trimmed(value: Column, decimals: int) -> Column:
    """Fixed decimals without trailing zeros, as text."""
    text = F.format_string(f"%.{decimals}f", F.round(value.cast("double"), decimals))
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value.isNotNull(), short)


def pressure_text(value: Column | str) -> Column:
    return F.concat(trimmed(norm_pressure(value), 2), F.lit(" cmH2O"))


def tidal_volume_text(value: Column | str, unit: Column | str) -> Column:
    return F.concat(trimmed(norm_tidal_volume_ml(value, unit), 1), F.lit(" mL"))


def ramp_time_text(value: Column | str) -> Column:
    v = _col(value)
    minutes = F.round(v, 2)
    unit = F.when(minutes == 1, " minute").otherwise(" minutes")
    return F.when(v == 0, "Off").when(v > 0, F.concat(trimmed(v, 2), unit))


RANGE_TEXT = r"(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)"


def pressure_setting_text(raw: Column | str) -> Column:
    """A settings text: a range stays as it is, a number becomes cmH2O, anything else stays text."""
    text = F.trim(_col(raw))
    return F.when(text != "", F.when(text.rlike(RANGE_TEXT), text)
                  .otherwise(F.coalesce(pressure_text(first_number(text)), text)))


def setting_number(text: Column | str) -> Column:
    """First number of a settings text."""
    return matched_number(_col(text), r"(-?\d+(?:\.\d+)?)")


def setting_range(text: Column | str) -> tuple[Column, Column]:
    """Both ends of an ``a-b`` range in a settings text."""
    c = _col(text)
    return tuple(F.regexp_extract(c, RANGE_TEXT, i).try_cast("double") for i in (1, 2))


def bytes_label(size: Column | str) -> Column:
    s = _col(size)
    mb = F.format_string("%.2f MB", F.round(s / F.lit(1024.0 * 1024.0), 2))
    kb = F.format_string("%.1f KB", F.round(s / F.lit(1024.0), 1))
    return F.when(s > 1024 * 1024, mb).when(s > 1024, kb).otherwise(F.concat(s.cast("string"), F.lit(" B")))
