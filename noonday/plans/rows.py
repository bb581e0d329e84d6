"""Report rows: labelled values by section, with emphasis and tone, out of the report metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonday.functions.circular import clock_text, hours_text
from noonday.functions.dates import human_date
from noonday.functions.modes import is_auto_bilevel, is_timed_bilevel
from noonday.functions.numbers import setting_number, setting_range

# Limits of the report flags.
AHI_LIMIT, COMPLIANCE_LIMIT, HOURS_LIMIT, LEAK_LIMIT, RATE_LIMIT, PRESSURE_TOLERANCE = 5, 70, 4, 30, 10, 0.1
METHOD_95 = {"mean-daily-95": "Avg daily 95th {}", "95-daily-95": "95th of daily 95th {}", "95-daily-summary": "95th daily {} summary"}


# Loaders whose leak is the total one, or whose bounds are configuration fields; warnings that a report repeats
# under the limits of its data.
TOTAL_LEAK_LOADER = r"(?i)^\s*philips respironics system one / dreamstation\s*$"
CONFIG_LOADER = r"(?i)^\s*resvent\s*/\s*hoffrichter\s*$"
BOUNDS_DIFFER = "Resvent PMin and EPAPMin configuration fields differ; confirm which bound is active on the device."
LIMIT_WARNINGS = (
    "Some Philips encrypted records could not be read; report data may be incomplete.",
    "Some Philips leak samples lack a usable session duration and were excluded from report summaries.",
    "BMC waveform samples could not be matched to confirmed mask-on intervals; pressure and leak summaries may include non-therapy periods.",
    "The latest BMC settings record is dated after the last therapy day; settings shown may not describe the report period.",
    "The latest Philips settings record is dated after the last therapy session; settings shown may not describe the report period.",
    BOUNDS_DIFFER,
)


def one(value: Column) -> Column:
    """One decimal, as text; nine decimals first, so that the last digits of a sum do not decide."""
    return F.when(value.isNotNull(), F.format_string("%.1f", F.round(F.round(value, 9), 1)))


def shown(value: Column, unit: str = "") -> Column:
    return F.when(value.isNotNull(), F.concat(one(value), F.lit(unit)))


def is_below(value: Column, limit: Column) -> Column:
    """Below a limit, compared after rounding both to one decimal."""
    near = lambda x: F.round(F.round(x, 9), 1)
    return F.coalesce(near(value) < near(limit), F.lit(False))


def pressure_is_low(value: Column, setting: Column) -> Column:
    return F.coalesce(setting > 0, F.lit(False)) & is_below(value, setting * (1 - PRESSURE_TOLERANCE))


def rate_is_low(value: Column, mode: Column, device: Column, backup: Column) -> Column:
    """Below ten breaths, or below the backup rate in timed bilevel modes."""
    timed = F.coalesce(is_timed_bilevel(mode, device), F.lit(False))
    return is_below(value, F.lit(float(RATE_LIMIT))) | (timed & is_below(value, setting_number(backup)))


def volume_is_low(litres: Column, setting_litres: Column) -> Column:
    return is_below(litres * 1000, setting_litres * 1000)


def volume_setting(text: Column) -> Column:
    """Litres of a volume setting: by its unit, else millilitres above ten."""
    value, low = setting_number(text), F.lower(text)
    litres = F.when(low.rlike(r"\b(?:ml|millilit(?:er|re)s?)\b"), value / 1000).when(low.rlike(r"\b(?:l|lit(?:er|re)s?)\b"), value)
    return F.when(value > 0, litres.otherwise(F.when(value > 10, value / 1000).otherwise(value)))


def volume_text(litres: Column, minutes: Column | None = None) -> Column:
    text = shown(litres * 1000, " mL")
    if minutes is None:
        return text
    return F.concat(text, F.coalesce(F.concat(F.lit("; "), one(minutes), F.lit(" sampled min total")), F.lit("")))


def flags() -> dict[str, Column]:
    return {
        "ahi_high": F.coalesce(F.col("avg_ahi") > AHI_LIMIT, F.lit(False)),
        "compliance_low": F.coalesce(F.col("compliance_percent") < COMPLIANCE_LIMIT, F.lit(False)),
        "use_low": F.coalesce(F.col("avg_usage_hours") < HOURS_LIMIT, F.lit(False)),
        "leak_high": F.coalesce(F.col("max_leak") > LEAK_LIMIT, F.lit(False)),
        "rate_low": is_below(F.col("rr_min"), F.lit(float(RATE_LIMIT))),
    }


def share_text(value: Column, total: Column) -> Column:
    """Hours and their share of the total; only hours when there is no total."""
    share = F.concat(F.lit(" ("), one(F.try_divide(value, total) * 100), F.lit("%)"))
    return F.when(value.isNotNull(), F.concat(one(value), F.lit(" h"), F.when(total > 0, share).otherwise("")))


def leak_text(value: Column, minutes: Column | None = None) -> Column:
    text = shown(value, " L/min")
    if minutes is None:
        return text
    part = F.when(minutes < 0.1, "<0.1").otherwise(one(minutes))
    return F.concat(text, F.when(minutes > 0, F.concat(F.lit("; episode "), part, F.lit(" min"))).otherwise(""))


def pressure_display(text: Column | str) -> Column:
    """A pressure setting as a report shows it: its number or its two ends with one decimal, or the text itself."""
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    numbers = F.transform(F.regexp_extract_all(raw, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    first, second = F.get(numbers, F.lit(0)), F.abs(F.get(numbers, F.lit(1)))
    ends = F.concat(one(first), F.lit("-"), one(second), F.lit(" cmH2O"))
    ranged = raw.rlike(r"\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?")
    return F.when(raw != "", F.when(ranged, ends).otherwise(F.coalesce(F.concat(one(first), F.lit(" cmH2O")), raw)))


def method_label(method: Column, name: str) -> Column:
    out = F.lit(f"95th {name}")
    for key, text in METHOD_95.items():
        out = F.when(method == key, text.format(name)).otherwise(out)
    return out


def either(names: Column) -> Column:
    """Names as running text: "a", "a or b", "a, b, or c"."""
    n = F.size(names)
    front = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    comma = F.when(n > 2, ", or ").otherwise(" or ")
    return F.when(n > 1, F.concat(front, comma, F.element_at(names, -1))).otherwise(F.array_join(names, ""))


BILEVEL = ("BiPAP", "VAuto")
PRESSURE_NAMES = ("pressure", "ipap", "epap")


def setting_rows(settings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The settings section: labelled rows that follow the mode, absent settings left out.

    ``settings`` has the texts device, mode, pressure, pressure_min, pressure_max, epap, ipap, respiratory_rate,
    tidal_volume, ramp_time, ramp_pressure, pressure_relief, and the flag pressure_auto.  A bilevel device shows its two
    pressures, or the two bounds if it adjusts itself; other devices the range, or the one pressure that is set.
    """
    c = F.col
    bilevel = F.coalesce(c("mode").isin(*BILEVEL), F.lit(False))
    ranged = F.coalesce(c("pressure_auto"), F.lit(False)) | F.coalesce("pressure_min", "pressure_max").isNotNull()
    auto = ~bilevel & ((c("mode") == "APAP") | ranged) & ~F.coalesce(c("mode") == "CPAP", F.lit(False))
    auto = F.coalesce(auto, F.lit(False))
    config = c("loader").rlike(CONFIG_LOADER) if "loader" in settings.columns else F.lit(False)
    volume = volume_setting(c("tidal_volume"))
    support = F.regexp_extract(F.trim("pressure_relief"), r"(?i)^ps\s*:?\s*(.+)$", 1)
    rate = setting_number("respiratory_rate")
    items = [
        ("Device", c("device"), F.lit(True)),
        ("Mode", c("mode"), F.lit(True)),
        (F.when(config, "Config PMin").otherwise("Min EPAP"), pressure_display("pressure_min"), bilevel & ranged),
        (F.when(config, "Config PMax").otherwise("Max IPAP"), pressure_display("pressure_max"), bilevel & ranged),
        ("IPAP", pressure_display("ipap"), bilevel & ~ranged),
        ("EPAP", pressure_display("epap"), bilevel & ~ranged),
        ("Respiratory rate (RR)", F.coalesce(F.concat(one(rate), F.lit(" bpm")), c("respiratory_rate")), bilevel),
        ("Tidal volume (Vt)", F.coalesce(shown(volume * 1000, " mL"), c("tidal_volume")), bilevel),
        ("Min pressure", pressure_display("pressure_min"), auto),
        ("Max pressure", pressure_display("pressure_max"), auto),
        ("Pressure", pressure_display("pressure"), ~bilevel & ~auto),
        ("Ramp time", c("ramp_time"), F.lit(True)),
        ("Ramp pressure", pressure_display("ramp_pressure"), F.lower(F.trim(F.coalesce("ramp_time", F.lit("")))) != "off"),
        (F.when(support != "", "Pressure support").otherwise("Pressure relief"), F.when(support != "", F.trim(support)).otherwise(c("pressure_relief")), F.lit(True)),
    ]
    rows = [
        F.struct(
            F.lit(n).alias("pos"), (label if isinstance(label, Column) else F.lit(label)).alias("label"),
            F.when(shown_for & (F.trim(text) != ""), text).alias("value"),
        )
        for n, (label, text, shown_for) in enumerate(items, 1)
    ]
    return settings.select(*keys, F.inline(F.array(*rows))).where("value IS NOT NULL")


def minimum_settings(given: Callable[[str], Column], bilevel: Column, differ: Column) -> dict[str, Column]:
    """The settings that measured pressures are held against, and the two bounds a report shows, as texts."""
    low, high = setting_range(given("pressure"))
    text = lambda v: F.concat(one(v), F.lit(" cmH2O"))
    auto = bilevel & (F.coalesce(is_auto_bilevel(given("mode")), F.lit(False)) | F.coalesce(given("pressure_min"), given("pressure_max")).isNotNull())
    fixed = F.when(given("mode") == "CPAP", given("pressure"))
    least = F.coalesce(given("pressure_min"), text(low), fixed)
    bound = F.when(~differ, setting_number(F.coalesce(given("pressure_min"), given("epap"), text(low))))
    return {
        "auto": auto, "low_text": least, "high_text": F.coalesce(given("pressure_max"), text(high), fixed), "pressure": setting_number(least),
        **{n: F.when(auto, bound).otherwise(setting_number(given(n))) for n in ("ipap", "epap")},
    }


def setting_flags(metrics: DataFrame) -> dict[str, Column]:
    """Whether measured values lie below the settings that ``metrics`` tells (the columns of :func:`setting_rows`).

    As in the rows of a report, the two pressures are held against them for bilevel devices only, the single one for the others.
    """
    c = F.col
    bilevel = F.coalesce(c("mode").isin(*BILEVEL), F.lit(False))
    differ = F.array_contains("warnings", BOUNDS_DIFFER) if "warnings" in metrics.columns else F.lit(False)
    setting = minimum_settings(c, bilevel, differ)
    return {
        "rate_low": rate_is_low(c("rr_min"), c("mode"), c("device"), c("respiratory_rate")),
        **{f"{n}_low": (~bilevel if n == "pressure" else bilevel) & pressure_is_low(c(f"{n}_mean"), setting[n]) for n in PRESSURE_NAMES},
        "volume_low": volume_is_low(c("vt_mean"), volume_setting(c("tidal_volume"))),
    }


def report_rows(metrics: DataFrame) -> DataFrame:
    """Long labelled rows; absent values are left out, and so are the sections that stay empty.

    Where ``metrics`` tells the settings (the columns of :func:`setting_rows`), the ventilation section and the two pressures
    are for bilevel devices only and the single pressure for the others, values below their setting are emphasized, and the
    settings are a section of their own.  Where it tells the ``loader``, labels follow it; where it tells the ``warnings``,
    those about the source data are repeated; where it has histogram metrics, they are shown.
    """
    c = F.col
    no = F.lit(False)
    given = lambda n: c(n) if n in metrics.columns else F.lit(None).cast("string")
    number = lambda n: c(n) if n in metrics.columns else F.lit(None).cast("double")
    told = "mode" in metrics.columns
    bilevel = F.coalesce(given("mode").isin(*BILEVEL), no)
    warned = lambda text: F.array_contains("warnings", text) if "warnings" in metrics.columns else no
    setting = minimum_settings(given, bilevel, warned(BOUNDS_DIFFER))
    loader = F.coalesce(given("loader"), F.lit(""))
    total_leak, config = loader.rlike(TOTAL_LEAK_LOADER), loader.rlike(CONFIG_LOADER)
    if told:
        own = {n: bilevel for n in ("ipap_95", "ipap_mean", "epap_95", "epap_mean", "vt_min", "vt_mean", "vt_max", "vt_median", "rr_min", "rr_mean", "rr_95")}
        own |= {n: ~bilevel for n in ("pressure_95", "pressure_mean")}
        metrics = metrics.withColumns({n: F.when(test, c(n)) for n, test in own.items() if n in metrics.columns})
    flag = flags()
    timed = c("timed")
    tone = F.when(c("confidence") == "high", "success").when(c("confidence") == "moderate", "warning").otherwise("danger")
    window = F.concat(
        clock_text(c("anchor_minutes")), F.lit(" to "), clock_text(c("window_end_minutes")), F.lit(" ("),
        F.initcap("confidence"), F.lit(" confidence)"),
    )
    days = c("days_in_window").cast("string")
    of_days = lambda n: F.concat(c(n).cast("string"), F.lit(" / "), days)
    weighted = lambda name: F.when(c(f"{name}_method") == "usage-weighted", "Usage-weighted").otherwise("Avg daily")

    usage = [
        ("Date range", F.concat(human_date("shown_start"), F.lit(" to "), human_date("shown_end")), no, None),
        ("Days with data", of_days("days_with_data"), no, None),
        ("Usage days (% of range)", F.concat(one(c("usage_days_percent")), F.lit("%")), no, None),
        ("Total time", shown(c("total_hours"), " h"), no, None),
        ("  Total sleep / therapy time", share_text(c("principal_hours"), c("total_hours")), no, None),
        ("  Total nap time", share_text(c("nap_hours"), c("total_hours")), no, None),
        (
            "Therapy time not assigned to sleep",
            F.when(timed & (c("unclassified_hours") >= 0.05), F.concat(hours_text(c("unclassified_hours")), F.lit(" (H:MM)"))),
            no, None,
        ),
        ("Inferred sleep window", F.when(timed, window), no, tone),
        (
            F.when(timed, "CMS-correlated days (principal episode >= 4h)").otherwise("Compliant days (daily total >= 4h)"),
            of_days("compliant_days"), flag["compliance_low"], None,
        ),
        ("Compliance (% of range)", F.concat(one(c("compliance_percent")), F.lit("%")), flag["compliance_low"], None),
        ("Avg total therapy per used day", shown(c("avg_usage_hours"), " h"), flag["use_low"], None),
    ]
    pressure = []
    for name, title in (("ipap", "IPAP"), ("epap", "EPAP"), ("pressure", "Pressure")):
        word = title if name != "pressure" else "pressure"
        low = lambda v, name=name: pressure_is_low(v, setting[name])
        pressure += [
            (method_label(c(f"{name}_95_method"), title), shown(c(f"{name}_95"), " cmH2O"), low(c(f"{name}_95")), None),
            (f"Avg daily {word} summary", shown(c(f"{name}_mean"), " cmH2O"), low(c(f"{name}_mean")), None),
        ]
    measured = F.coalesce("pressure_mean", "pressure_95", "ipap_mean", "ipap_95", "epap_mean", "epap_95").isNotNull()
    bounded = measured & (~bilevel | setting["auto"])
    bound = lambda at_bilevel, at_config, plain: F.when(bilevel & config, at_config).when(bilevel, at_bilevel).otherwise(plain)
    if told:
        pressure += [
            (bound("Min EPAP", "Config PMin", "Min Pressure"), F.when(bounded, pressure_display(setting["low_text"])), no, None),
            (bound("Max IPAP", "Config PMax", "Max Pressure"), F.when(bounded, pressure_display(setting["high_text"])), no, None),
        ]
    litres = volume_setting(given("tidal_volume"))
    little = lambda v: volume_is_low(v, litres)
    slow = lambda v: rate_is_low(v, given("mode"), given("device"), given("respiratory_rate"))
    ventilation = [
        ("Min Vt (tidal volume)", volume_text(c("vt_min"), number("vt_min_minutes")), little(c("vt_min")), None),
        ("Median Vt (tidal volume)", volume_text(number("vt_median")), little(number("vt_median")), None),
        ("Avg daily Vt (tidal volume)", volume_text(c("vt_mean")), little(c("vt_mean")), None),
        ("Max Vt (tidal volume)", volume_text(c("vt_max"), number("vt_max_minutes")), little(c("vt_max")), None),
        ("Min RR", shown(c("rr_min"), " bpm"), slow(c("rr_min")), None),
        ("Avg RR", shown(c("rr_mean"), " bpm"), slow(c("rr_mean")), None),
        ("95th RR", shown(number("rr_95"), " bpm"), slow(number("rr_95")), None),
    ]
    events = [
        (
            F.when(c("ahi_method") == "usage-weighted", "Usage-weighted AHI").otherwise("Avg daily AHI"), shown(c("avg_ahi")),
            flag["ahi_high"], None,
        ),
        ("95th daily AHI", shown(c("ahi_95")), F.coalesce(c("ahi_95") > AHI_LIMIT, no), None),
        (F.concat(weighted("residual"), F.lit(" apnea index")), shown(c("avg_residual")), no, None),
        ("95th daily apnea index", shown(c("residual_95")), no, None),
        (F.concat(weighted("central"), F.lit(" central apnea index")), shown(c("avg_central")), no, None),
        ("95th daily central apnea index", shown(c("central_95")), no, None),
        (F.concat(weighted("rera"), F.lit(" RERA index")), shown(c("avg_rera")), no, None),
    ]
    high = lambda v: ~total_leak & F.coalesce(v > LEAK_LIMIT, no)
    leak_95 = F.when(total_leak, method_label(c("leak_95_method"), "total leak")).otherwise(method_label(c("leak_95_method"), "leak"))
    leaks = [
        (F.when(total_leak, "Avg daily total leak summary").otherwise("Avg daily leak summary"), leak_text(c("leak_mean")), high(c("leak_mean")), None),
        (leak_95, leak_text(c("leak_95")), high(c("leak_95")), None),
        (
            "Peak in Longest Leak Episode",
            F.when(c("sustained_leak_minutes").isNotNull(), leak_text(c("sustained_leak_max"), c("sustained_leak_minutes"))),
            high(c("sustained_leak_max")), None,
        ),
        (F.when(total_leak, "Max Total Leak").otherwise("Max Leak"), leak_text(c("max_leak"), c("max_leak_minutes")), high(c("max_leak")), None),
    ]
    missing = F.array_compact(
        F.array(
            F.when(~measured, "measured pressure"),
            F.when(F.coalesce("avg_ahi", "avg_residual", "avg_central", "avg_rera").isNull(), "respiratory event"),
            F.when(F.coalesce("leak_mean", "leak_95", "max_leak").isNull(), "leak"),
        )
    )
    limits = [
        (
            "Card data",
            F.when(
                F.size(missing) > 0,
                F.concat(F.lit("No "), either(missing), F.lit(" summaries were available in the imported files.")),
            ),
            no, None,
        ),
        *[("Card data", F.when(warned(text), text), no, None) for text in LIMIT_WARNINGS if "warnings" in metrics.columns],
    ]
    sections = (
        ("Usage Summary", usage), ("BiPAP Report Information", ventilation), ("Therapy Pressures", pressure),
        ("Respiratory Events", events), ("Leaks", leaks), ("Source Data Limits", limits),
    )
    rows, pos = [], 0
    for section, items in sections:
        for label, value, emphasize, item_tone in items:
            pos += 1
            rows.append(
                F.struct(
                    F.lit(section).alias("section"), F.lit(pos).alias("pos"),
                    (label if isinstance(label, Column) else F.lit(label)).alias("label"), value.alias("value"),
                    F.coalesce(emphasize, no).alias("emphasize"),
                    (item_tone if item_tone is not None else F.lit("")).alias("tone"),
                )
            )
    keys = ["card_id", "range_days", "kind"]
    shown_rows = metrics.select(*keys, F.inline(F.array(*rows))).where(F.col("value").isNotNull())
    if not told:
        return shown_rows
    machine = setting_rows(metrics, keys).select(
        *keys, F.lit("Machine Settings").alias("section"), (F.col("pos") + pos).alias("pos"), "label", "value", no.alias("emphasize"), F.lit("").alias("tone")
    )
    return shown_rows.unionByName(machine)
