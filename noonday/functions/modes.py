"""Therapy modes and device names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


# Mode words, matched against the normalised mode text.
AUTO_MODES = (
    r"\bapap\b", r"\bautoset\b", r"\bauto pap\b", r"\bautomatic pap\b", r"\bauto cpap\b", r"\bautomatic cpap\b",
    r"\bcpap auto\b", r"^auto$", r"^automatic$",
)
BILEVEL_MODES = (
    r"\bbipap\b", r"\bbi level\b", r"\bbilevel\b", r"\bautobilevel\b", r"\bauto bilevel\b", r"\bautobipap\b",
    r"\bauto bipap\b", r"\bvpap\b", r"\bvauto\b", r"\blumis\b", r"\basv\b", r"\bautosv\b", r"\bavaps\b", r"\bs t\b",
    r"^st$", r"\bst a\b", r"^s30$", r"\bauto s30\b", r"\bauto st30\b", r"^t30$", r"^pc$",
)
AUTO_BILEVEL_MODES = (
    r"\bautobilevel\b", r"\bauto bilevel\b", r"\bautobipap\b", r"\bauto bipap\b", r"\bvauto\b", r"\basv\b",
    r"\bautosv\b", r"\bavaps\b", r"\bauto s\b", r"\bauto st\b", r"\bauto s30\b", r"\bauto st30\b",
)
# Product and profile names, in order of precedence.
NAME_MODES = (
    (r"(?i)\b(?:herauto|autoset(?:\s+for\s+her)?)\b", "APAP"),
    (r"(?i)\b(?:vauto|adapt|asvauto)\b", "BiPAP"),
    (r"(?i)\b(?:autoset|auto for her)\b", "APAP"),
    (r"(?i)\b(?:aircurve|vpap|vauto|asv|autosv|ivaps|lumis|pacewave|bilevel|bi[- ]?level|st-a|st)\b", "BiPAP"),
    (r"(?i)\b(?:cpap|elite)\b", "CPAP"),
)
PROFILE_MODES = (
    (r"(?i)^cpap(?:\s*profile)?$", "CPAP"),
    (r"(?i)^(?:autoset|autoset profile|autosetforherprofile|autoset for her profile|herauto|auto set for her)$", "APAP"),
    (r"(?i)(?:vauto|bilevel|vpap|lumis|asv|asvauto|ivaps|st-a|st|pacewave)", "BiPAP"),
)
MODEL_MODES = (
    (r"(?i)^(?:2\d{2}[A-Z]*|4\d{2}[A-Z]*|410X150C|420X150C)$", "CPAP"),
    (r"(?i)^(?:5\d{2}[A-Z]*|501V|520X110C|520X130C|520X150C|521X120C|521X140C)$", "APAP"),
    (
        r"(?i)^(?:6\d{2}[A-Z]*|7\d{2}[A-Z]*|9\d{2}[A-Z]*|10\d{2}.*|11\d{2}.*|1030X110|1030X150|1061401|1061T|1130X110"
        r"|1130X200|1131X150|1160P)$",
        "BiPAP",
    ),
)


def normalize_mode(mode: Column | str) -> Column:
    text = F.regexp_replace(F.lower(F.coalesce(_c(mode), F.lit(""))), r"[/_-]+", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_auto(mode: Column | str) -> Column:
    return normalize_mode(mode).rlike(_any(AUTO_MODES))


def is_bilevel(mode: Column | str) -> Column:
    return normalize_mode(mode).rlike(_any(BILEVEL_MODES))


def is_auto_bilevel(mode: Column | str) -> Column:
    return normalize_mode(mode).rlike(_any(AUTO_BILEVEL_MODES))


def is_fixed(mode: Column | str) -> Column:
    return normalize_mode(mode).contains("cpap") & ~is_auto(mode)


def explicit_mode(mode: Column | str) -> Column:
    """Mode a text names: bilevel before automatic before fixed; NULL if it names none."""
    return F.when(is_bilevel(mode), "BiPAP").when(is_auto(mode), "APAP").when(is_fixed(mode), "CPAP")


def has_text(c: Column | str) -> Column:
    return F.coalesce(F.length(_c(c)) > 0, F.lit(False))


def evidence_mode() -> Column:
    """Mode the settings columns of a row speak for, without its label."""
    auto = F.coalesce(F.col("pressure_auto"), F.lit(False))
    return (
        F.when(has_text("respiratory_rate") | has_text("tidal_volume") | (has_text("epap") & has_text("ipap")), "BiPAP")
        .when(auto | has_text("pressure_min") | has_text("pressure_max"), "APAP")
        .when(has_text("pressure"), "CPAP")
    )


def classify_mode(mode: Column | str = "mode") -> Column:
    return F.coalesce(explicit_mode(mode), evidence_mode())


def report_layout(mode: Column | str = "mode") -> Column:
    one_page = normalize_mode(mode).rlike(r"\bauto s30\b")
    return F.when(one_page, "one-page-cpap").when(classify_mode(mode) == "BiPAP", "two-page-bipap").otherwise(
        "one-page-cpap"
    )


def first_label(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Label of the first rule of an ordered list that matches; NULL if none does."""
    out = None
    for pattern, label in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def tidy(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"[_\s]+", " "))


def mode_from_name(name: Column | str) -> Column:
    return first_label(_c(name), NAME_MODES)


def mode_from_model(model: Column | str) -> Column:
    return first_label(_c(model), MODEL_MODES)


def mode_from_profile(*candidates: Column | str) -> Column:
    """First candidate text (therapy mode, profile, device) that tells a mode."""
    return F.coalesce(
        *[F.coalesce(first_label(tidy(c), PROFILE_MODES), explicit_mode(tidy(c))) for c in candidates]
    )


def mode_from_signals(bilevel: Column, automatic: Column, fixed: Column) -> Column:
    """Mode from the kinds of pressure signals present."""
    return F.when(bilevel, "BiPAP").when(automatic, "APAP").when(fixed, "CPAP")


def is_timed_bilevel(mode: Column | str, device: Column | str) -> Column:
    both = F.concat_ws(" ", F.coalesce(_c(mode), F.lit("")), F.coalesce(_c(device), F.lit("")))
    return normalize_mode(both).rlike(r"\b(?:s t|st|st a|st30|ast30|30sta)\b")


# Device names, most specific first.
DEVICE_LABELS = (
    "AirSense 11 AutoSet for Her", "AirSense 11 AutoSet", "AirSense 11 Elite", "AirSense 11 CPAP", "AirCurve 11 ST-A",
    "AirCurve 11 ST", "AirCurve 11 VAuto", "AirCurve 11 ASV", "AirSense 11", "AirCurve 11",
    "AirSense 10 AutoSet for Her", "AirSense 10 AutoSet", "AirSense 10 Elite", "AirSense 10 CPAP", "AirCurve 10 ST-A",
    "Lumis 150 VPAP ST-A", "AirCurve 10 ST", "Lumis 150 VPAP ST", "AirCurve 10 VAuto", "AirCurve 10 ASV",
    "AirCurve 10 S", "Lumis 100 VPAP S", "AirSense 10", "AirCurve 10", "Sleepmate 10", "S9",
)
DEVICE_NAMES = tuple((r"(?i)\b" + label.replace(" ", r"\s*") + r"\b", label) for label in DEVICE_LABELS)


def device_name(name: Column | str, rules: tuple[tuple[str, str], ...] = DEVICE_NAMES) -> Column:
    """Canonical device name by an ordered pattern list, else the tidied text."""
    text = tidy(name)
    return F.coalesce(first_label(text, rules), text)


def serial_from_path(path: Column | str) -> Column:
    found = F.regexp_extract(_c(path), r"(?i)(?:^|/)od([^/]+)(?:/|$)", 1)
    return F.when(found != "", found)


# Fixed value: device lines that name one of the family.
DEVICE_FAMILY = r"(?i)(?:airsense|aircurve|sleepmate|s9)"


def device_identity(text: Column | str, device_line: Column | str | None = None) -> Column:
    """Device name out of an identification file: its product object, its identification line, a device line, any mention."""
    c = _c(text)
    squeezed = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    named = lambda t: F.when(squeezed(t) != "", device_name(squeezed(t)))
    ident = F.regexp_extract(c, r"(?m)^[ \t]*#PNA ([^\r\n]*)", 1)
    reads = [named(F.get_json_object(c, "$.ProductName")), named(ident)]
    if device_line is not None:
        reads.append(F.when(_c(device_line).rlike(DEVICE_FAMILY), named(_c(device_line))))
    hints = [F.when(c.rlike(pattern), F.lit(label)) for pattern, label in DEVICE_NAMES]
    return F.coalesce(*reads, *hints)
