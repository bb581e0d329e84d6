"""Machine settings: cleaning, signatures, alias reads, ramp and mode rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonday.functions.modes import (
    classify_mode, evidence_mode, explicit_mode, has_text, is_auto, is_auto_bilevel,
)
from noonday.functions.plan import computed_once
from noonday.functions.numbers import (
    RANGE_TEXT, norm_pressure, pressure_text, ramp_time_text, safe_number, setting_number, tidal_volume_text, trimmed,
)

OFF_WORDS = r"(?i)^(?:off|disabled|false|no|0)$"
ON_WORDS = r"(?i)^(?:on|enabled|true|yes|auto)$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_setting(value: Column | str) -> Column:
    """Trimmed text with one spelling of the pressure unit; NULL when empty."""
    text = F.regexp_replace(F.trim(_c(value)), r"(?i)\s*\(\s*cmh?2o\s*\)\s*$", " cmH2O")
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def signature_text(value: Column) -> Column:
    low = F.regexp_replace(F.lower(value), r"\s*\(\s*cmh?2o\s*\)\s*", " cmh2o")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def joined_range(low: Column, high: Column) -> Column:
    return F.coalesce(F.concat(low, F.lit("-"), high), low, high)


def settings_snapshot(
    mode: Column | str, pressure: Column | str, pressure_min: Column | str, pressure_max: Column | str,
    epap: Column | str, ipap: Column | str,
) -> Column:
    """Signature, label and machine struct of one set of settings; NULL when nothing is set.

    Rate, volume and relief are left out on purpose: only a change of pressure or mode opens a new settings period.
    """
    m, lo, hi, e, i = (clean_setting(c) for c in (mode, pressure_min, pressure_max, epap, ipap))
    return _snapshot_of(m, _unfixed(clean_setting(pressure)), lo, hi, e, i)


def _unfixed(pressure: Column) -> Column:
    """A cleaned pressure text without the word "fixed"; NULL when nothing else is there."""
    return F.nullif(F.trim(F.regexp_replace(pressure, r"(?i)^fixed\s+", "")), F.lit(""))


def _snapshot_of(m: Column, p: Column, lo: Column, hi: Column, e: Column, i: Column) -> Column:
    """Snapshot of cleaned texts: mode, pressure, its range, EPAP and IPAP."""
    named = (("mode", m), ("pressure", p), ("pressureMin", lo), ("pressureMax", hi), ("epap", e), ("ipap", i))
    parts = F.array_compact(F.array(*[F.concat(F.lit(f"{k}:"), signature_text(v)) for k, v in named]))
    range_text = joined_range(lo, hi)
    bilevel = e.isNotNull() | i.isNotNull()
    detail = F.concat_ws(
        " / ",
        F.concat(F.lit("EPAP "), e), F.concat(F.lit("IPAP "), i),
        F.when(~bilevel, F.coalesce(range_text, p)),
    )
    label = F.trim(F.concat_ws(" ", F.coalesce(m, F.lit("Therapy")), F.when(detail != "", detail)))
    auto = lo.isNotNull() | hi.isNotNull()
    machine = F.struct(
        m.alias("mode"), F.concat(F.lit("Fixed "), p).alias("pressure"), lo.alias("pressure_min"),
        hi.alias("pressure_max"), F.when(auto, F.lit(True)).alias("pressure_auto"), e.alias("epap"), i.alias("ipap"),
    )
    return F.when(
        F.size(parts) > 0,
        F.struct(
            F.concat_ws("|", F.sort_array(parts)).alias("signature"), label.alias("label"), machine.alias("machine")
        ),
    )


# --- reads by alias --------------------------------------------------------------------------------------------


def compact_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), r"[\s_-]+", "")


def read_alias(exact: Column | str, compact: Column | str, aliases: Sequence[str]) -> Column:
    """First alias present, by its exact key or by its key without case, blanks, dashes and underscores.

    The maps hold (value, number) structs.
    """
    return _alias_entry(exact, compact, aliases)["value"]


def _alias_entry(exact: Column | str, compact: Column | str, aliases: Sequence[str]) -> Column:
    squeeze = str.maketrans("", "", " _-\t")
    reads = []
    for alias in aliases:
        reads.append(F.try_element_at(_c(exact), F.lit(alias)))
        reads.append(F.try_element_at(_c(compact), F.lit(alias.lower().translate(squeeze))))
    return F.coalesce(*reads)


# Keys under which settings files name a setting, in order of preference.
SETTING_ALIASES = {
    "vent_mode": ("VentMode", "vent mode", "ventMode"),
    "mode": ("therapyMode", "therapy mode", "mode", "papMode", "pap mode"),
    "pressure": ("Press", "pressure", "setPressure", "set pressure", "CPAPPressure", "CPAP pressure"),
    "pressure_min": ("PMin", "pressureMin", "minPressure", "minimumPressure", "setMinPressure", "autoMin"),
    "pressure_max": ("PMax", "pressureMax", "maxPressure", "maximumPressure", "setMaxPressure", "autoMax"),
    "epap": ("EPAP", "epapSet", "setEPAP", "set_epap"),
    "epap_min": ("EPAPMin", "EPAP minimum", "EPAPMinPressure"),
    "epap_max": ("EPAPMax", "EPAP maximum", "EPAPMaxPressure"),
    "ipap": ("IPAP", "ipapSet", "setIPAP", "set_ipap"),
    "ipap_min": ("IPAPMin", "IPAP minimum", "IPAPMinPressure"),
    "ipap_max": ("IPAPMax", "IPAP maximum", "IPAPMaxPressure"),
    "rate": ("RR", "rrSet", "respiratoryRate", "backupRate", "backup rate"),
    "volume": ("VT", "vtSet", "targetVT", "targetVt", "tidalVolume", "targetTidalVolume"),
    "relief": ("EPR", "Flex", "pressureRelief", "pressure relief", "IPR"),
    "support": ("PS", "pressureSupport", "pressure support"),
    "ramp_time": ("rampTime", "rampMinutes", "rampTimeMinutes", "rampDuration"),
    "ramp_pressure": ("rampPress", "rampPressure", "pRamp", "rampStartPressure", "rampStartPress"),
}
# Patterns of squeezed keys that name a setting where none of its aliases does, in order of preference, and of
# lower-case keys that name a pressure relief.
SETTING_PATTERNS = {
    "ramp_time": (r"^ramp(?:time|minutes|duration)$", r"^.*ramp.*(?:time|minutes|duration).*$"),
    "ramp_pressure": (r"^.*ramp.*(?:press|pressure).*$", r"^(?:press|pressure).*ramp.*$"),
}
RELIEF_PATTERN = r"\b(?:epr|ipr|flex|exhale)\b"


def read_pattern(entries: Column | str, compact: Column | str, patterns: Sequence[str]) -> Column:
    """Value of the first key, in file order, that fits any of the patterns; equal squeezed keys have one value, the last."""
    return _pattern_entry(entries, compact, patterns)["value"]


def _pattern_entry(entries: Column | str, compact: Column | str, patterns: Sequence[str]) -> Column:
    hits = F.filter(_c(entries), lambda e: e["compact"].rlike("|".join(f"(?:{p})" for p in patterns)))
    return F.try_element_at(_c(compact), F.try_element_at(hits, F.lit(1))["compact"])


# Mode names by the number in a settings file.
VENT_MODES = {
    "1": "CPAP", "3": "APAP", "10": "S30", "11": "Auto S30", "12": "ST30", "13": "Auto ST30", "14": "T30", "15": "PC",
}


# The raw fields that each settings text is made of; fields that hold pressures, and the daily record's settings.
RAW_FIELDS = {
    "mode": ("vent_mode", "mode"), "pressure": ("pressure",), "pressure_min": ("pressure_min",), "pressure_max": ("pressure_max",),
    "epap": ("epap", "epap_min", "epap_max"), "ipap": ("ipap", "ipap_min", "ipap_max"), "respiratory_rate": ("rate",),
    "tidal_volume": ("volume",), "pressure_relief": ("support", "relief"), "ramp_time": ("ramp_time",),
    "ramp_pressure": ("ramp_pressure", "ramp_time"),
}
PRESSURE_FIELDS = ("pressure", "pressure_min", "pressure_max", "epap", "epap_min", "epap_max", "ipap", "ipap_min", "ipap_max", "support")
DAY_SETTINGS = ("mode", "pressure", "pressure_min", "pressure_max", "epap", "ipap")


def raw_entries(
    exact: Column | str, compact: Column | str, entries: Column | str | None = None, fields: Sequence[str] = tuple(SETTING_ALIASES)
) -> dict[str, Column]:
    """The (value, number) that a key-value map has for each field: by its aliases first, then by its patterns in file order."""
    out = {}
    for field in fields:
        out[field] = _alias_entry(exact, compact, SETTING_ALIASES[field])
        if entries is not None and field in SETTING_PATTERNS:
            out[field] = F.coalesce(out[field], _pattern_entry(entries, compact, SETTING_PATTERNS[field]))
    return out


def with_settings(
    maps: DataFrame, prefix: str = "set_", entries: str | None = None, names: Sequence[str] = tuple(RAW_FIELDS), keep: Sequence[str] | None = None
) -> DataFrame:
    """Key-value maps with a column for each settings text of ``names``; ``keep`` names the columns that stay beside them.

    Every step is a set of columns of its own, so that a map is looked up once per alias and a text is parsed and written once:
    the entries, their texts and numbers, the numbers as pressures, the pressures as texts, the settings.
    """
    kept = maps.columns if keep is None else list(keep)
    fields = list(dict.fromkeys(f for n in names for f in RAW_FIELDS[n]))
    pressures = [f for f in fields if f in PRESSURE_FIELDS]
    stay = [F.col(f"`{c}`") for c in kept]

    def step(df: DataFrame, columns: dict[str, Column], *more: str) -> DataFrame:
        return computed_once(df.select(*stay, *more, *[c.alias(n) for n, c in columns.items()]))

    found = step(maps, {f"__e_{f}": c for f, c in raw_entries("exact", "compact", entries, fields).items()})
    # the maps carry the leading number of each value
    lead = {f: F.col(f"__e_{f}.number") for f in fields}
    inside = {f: F.coalesce(lead[f], setting_number(f"__e_{f}.value")) for f in fields if f in (*PRESSURE_FIELDS, "rate", "volume")}
    read = step(found, {f"__r_{f}": F.col(f"__e_{f}.value") for f in fields} | {f"__n_{f}": c for f, c in (lead | inside).items()})
    raws, numbers = [f"__r_{f}" for f in fields], [f"__n_{f}" for f in fields if f not in pressures]
    normed = step(
        read,
        {f"__n_{f}": norm_pressure(f"__n_{f}") for f in pressures}
        | {f"__t_{f}": F.nullif(F.trim(f"__r_{f}"), F.lit("")) for f in pressures},
        *raws, *numbers,
    )
    written = step(
        normed,
        {
            f"__p_{f}": F.when(F.col(f"__t_{f}").rlike(RANGE_TEXT), F.col(f"__t_{f}")).otherwise(
                F.coalesce(F.concat(trimmed(F.col(f"__n_{f}"), 2), F.lit(" cmH2O")), F.col(f"__t_{f}"))
            )
            for f in pressures
        },
        *raws, *numbers,
    )
    texts = _settings_texts(names)
    return step(written, {prefix + n: texts[n] for n in names})


def _settings_texts(names: Sequence[str]) -> dict[str, Column]:
    """Settings texts out of the columns of the steps: raw texts, numbers and pressure texts of each field."""
    raw, number, pressure = (lambda f, kind=kind: F.col(f"__{kind}_{f}") for kind in "rnp")
    vent, mode = raw("vent_mode"), raw("mode")
    named = F.coalesce(*[F.when(vent == code, name) for code, name in VENT_MODES.items()])
    ramp = F.when(number("ramp_time").isNotNull(), ramp_time_text(number("ramp_time"))).otherwise(_ramp_word(raw("ramp_time")))
    off = F.coalesce(ramp.rlike(OFF_WORDS), F.lit(False))
    return {
        "mode": F.when(vent.isNotNull(), F.coalesce(named, mode, F.concat(F.lit("VentMode "), vent))).otherwise(mode),
        "pressure": pressure("pressure"),
        "pressure_min": pressure("pressure_min"),
        "pressure_max": pressure("pressure_max"),
        "epap": F.coalesce(pressure("epap"), joined_range(pressure("epap_min"), pressure("epap_max"))),
        "ipap": F.coalesce(pressure("ipap"), joined_range(pressure("ipap_min"), pressure("ipap_max"))),
        "respiratory_rate": F.concat(trimmed(number("rate"), 2), F.lit(" bpm")),
        "tidal_volume": tidal_volume_text(number("volume"), raw("volume")),
        "pressure_relief": F.coalesce(F.concat(F.lit("PS "), pressure("support")), raw("relief")),
        "ramp_time": ramp,
        "ramp_pressure": F.when(~off, pressure_text(number("ramp_pressure"))),
    }


def with_day_settings(maps: DataFrame, name: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Maps with the settings snapshot of a daily record (NULL when nothing is set); ``keep`` names the columns that stay."""
    kept = maps.columns if keep is None else list(keep)
    read = with_settings(maps, "__set_", names=DAY_SETTINGS, keep=kept)
    stay = [F.col(f"`{c}`") for c in kept]
    clean = computed_once(read.select(*stay, *[clean_setting(f"__set_{c}").alias(f"__set_{c}") for c in DAY_SETTINGS]))
    plain = computed_once(clean.withColumn("__set_pressure", _unfixed(F.col("__set_pressure"))))
    return computed_once(plain.select(*stay, _snapshot_of(*[F.col(f"__set_{c}") for c in DAY_SETTINGS]).alias(name)))


def relief_text(exact: Column, lower: Column, entries: Column | None = None) -> Column:
    """Pressure relief from a map: IPR, then EPR level, then Flex level, as on/off text, else the first key that names one."""

    def read(*keys: str) -> Column:
        tries = []
        for k in keys:
            tries += [F.try_element_at(exact, F.lit(k)), F.try_element_at(lower, F.lit(k.lower()))]
        return F.coalesce(*tries)["number"]

    def level(label: str, n: Column, unit: str = "") -> Column:
        on = F.concat(F.lit(f"{label}: On "), trimmed(n, 2), F.lit(unit))
        return F.when(n > 0, on).when(n.isNotNull(), F.lit(f"{label}: Off"))

    def told(e: Column) -> Column:
        name = F.upper(e["key"])
        on = F.concat(name, F.lit(": On "), trimmed(e["number"], 2))
        text = F.trim(e["value"])
        return F.when(e["number"] > 0, on).when(e["number"].isNotNull(), F.concat(name, F.lit(": Off"))).when(text != "", text)

    levels = [
        level("IPR", read("iPR"), " cmH2O"),
        level("EPR", read("EPRLevel", "epr_level", "EPR")),
        level("Flex", read("Flex", "A-Flex", "C-Flex")),
    ]
    if entries is not None:
        texts = F.transform(F.filter(entries, lambda e: F.lower(e["key"]).rlike(RELIEF_PATTERN)), told)
        levels.append(F.try_element_at(F.filter(texts, lambda x: x.isNotNull()), F.lit(1)))
    return F.coalesce(*levels)


def ramp_rule_text(raw: Column) -> Column:
    """Ramp time text out of a settings text: minutes, "Off", or an on-word as it stands."""
    n = safe_number(raw)
    return F.when(n.isNotNull(), ramp_time_text(n)).otherwise(_ramp_word(raw))


def _ramp_word(raw: Column) -> Column:
    return F.when(F.trim(raw).rlike(OFF_WORDS), "Off").when(F.trim(raw).rlike(ON_WORDS), F.trim(raw))


def ramp_rule(enable: Column, minutes: Column, pressure: Column) -> tuple[Column, Column]:
    """Ramp time and pressure: a toggle that is off wins, else the minutes, else "On"; no pressure when off."""
    time = F.when(enable <= 0, "Off").otherwise(
        F.coalesce(ramp_time_text(minutes), F.when(enable > 0, "On"))
    )
    off = F.coalesce(time == "Off", F.lit(False))
    valid = F.when(pressure.between(0, 80), F.concat(trimmed(pressure, 2), F.lit(" cmH2O")))
    return time, F.when(~off, valid)


def is_setting_header(header: Column | str) -> Column:
    """Table headers that name a therapy setting, compared without case, blanks and punctuation."""
    compact = F.regexp_replace(F.lower(_c(header)), r"[\s_\-/%().]+", "")
    return compact.rlike(SETTING_HEADERS)


# Table headers that name a therapy setting.
SETTING_HEADERS = (
    r"^(?:(?:therapy|pap|vent)?mode|press|pressure|setpressure|cpappressure"
    r"|pmin|pmax|pressuremin|pressuremax|minpressure|maxpressure|minimumpressure|maximumpressure|setminpressure"
    r"|setmaxpressure|automin|automax"
    r"|epap|ipap|epapset|ipapset|setepap|setipap|ipapmin|ipapmax|epapmin|epapmax|ipapminpressure|ipapmaxpressure"
    r"|epapminpressure|epapmaxpressure"
    r"|rr|rrset|respiratoryrate|backuprate|vt|vtset|targetvt|tidalvolume|targettidalvolume|epr|flex|pressurerelief|ipr"
    r"|ps|pressuresupport)$"
)

# --- mode rules ------------------------------------------------------------------------------------------------

MACHINE = (
    "mode", "pressure", "pressure_min", "pressure_max", "pressure_auto", "epap", "ipap", "respiratory_rate",
    "tidal_volume",
)
BILEVEL_ONLY = ("epap", "ipap", "respiratory_rate", "tidal_volume")


def _drop_when(test: Column, names: Sequence[str]) -> dict[str, Column]:
    return {n: F.when(~test, F.col(n)) for n in names}


def normalize_machine(df: DataFrame) -> DataFrame:
    """Settings columns made consistent before the mode is resolved; ranges are read out of the pressure text."""
    stated = F.coalesce(explicit_mode("mode"), F.lit("?"))
    single = stated.isin("APAP", "CPAP")
    range_set = has_text("pressure_min") | has_text("pressure_max")
    auto_bilevel = is_auto_bilevel("mode") | range_set
    bilevel = stated == "BiPAP"
    first = computed_once(df).withColumns(
        {
            **_drop_when(single, BILEVEL_ONLY),
            **_drop_when(bilevel & ~auto_bilevel, ("pressure_min", "pressure_max")),
            "pressure_auto": F.when(bilevel, auto_bilevel).otherwise(F.coalesce("pressure_auto", F.lit(False)))
            | is_auto("mode") | (range_set & ~(bilevel & ~auto_bilevel)),
        }
    )
    first = computed_once(first)
    text = F.coalesce("pressure", F.lit(""))
    bilevel_text = text.rlike(r"(?i)\b(?:epap|ipap)\b")

    def part(pattern: str, group: int) -> Column:
        return norm_pressure(safe_number(F.regexp_extract(text, pattern, group)))

    plain_range = r"(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)"
    low, high = part(plain_range, 1), part(plain_range, 2)
    wants = ~(has_text("pressure_min") & has_text("pressure_max")) & ~bilevel_text

    def from_text(name: str) -> Column:
        pattern = rf"(?i){name}\s*(-?\d+(?:\.\d+)?)(?:\s*-\s*(-?\d+(?:\.\d+)?))?"
        a, b = part(pattern, 1), part(pattern, 2)
        span = F.concat(trimmed(a, 2), F.lit("-"), trimmed(b, 2), F.lit(" cmH2O"))
        return F.when(bilevel_text, F.coalesce(span, pressure_text(a)))

    return first.withColumns(
        {
            "pressure_min": F.when(wants & ~has_text("pressure_min"), pressure_text(low)).otherwise(F.col("pressure_min")),
            "pressure_max": F.when(wants & ~has_text("pressure_max"), pressure_text(high)).otherwise(F.col("pressure_max")),
            "pressure_auto": F.col("pressure_auto") | F.coalesce(wants & (low.isNotNull() | high.isNotNull()), F.lit(False)),
            "epap": F.when(has_text("epap"), F.col("epap")).otherwise(from_text("epap")),
            "ipap": F.when(has_text("ipap"), F.col("ipap")).otherwise(from_text("ipap")),
        }
    )


def sanitize_machine(df: DataFrame, canonical: str = "canonical_mode") -> DataFrame:
    """Drop the settings columns that contradict the canonical mode."""
    mode = F.col(canonical)
    single, fixed = mode.isin("CPAP", "APAP"), mode == "CPAP"
    auto_bilevel = is_auto_bilevel("mode") | has_text("pressure_min") | has_text("pressure_max")
    return df.withColumns(
        {
            **_drop_when(single, BILEVEL_ONLY),
            **_drop_when(fixed | ((mode == "BiPAP") & ~auto_bilevel), ("pressure_min", "pressure_max")),
            "pressure_auto": F.when(fixed, False).when(mode == "APAP", True).when(mode == "BiPAP", auto_bilevel)
            .otherwise(F.col("pressure_auto")),
        }
    )


def resolve_machine(df: DataFrame) -> DataFrame:
    """Canonical mode, cleaned settings and an error text where no mode is found or the evidence contradicts it."""
    resolved = computed_once(normalize_machine(df)).withColumn("canonical_mode", classify_mode("mode"))
    labelled = computed_once(resolved).withColumn("mode", F.when(explicit_mode("mode").isNull(), F.col("canonical_mode")).otherwise(F.col("mode")))
    clean = computed_once(sanitize_machine(labelled))
    evidence = evidence_mode()
    return clean.withColumn(
        "mode_error",
        F.when(F.col("canonical_mode").isNull(), "not verified").when(evidence != F.col("canonical_mode"), "inconsistent"),
    )
