"""Report metrics per card, range and settings period, from day buckets, sessions and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day, human_date
from noonday.operators import sleep
from noonday.operators.cleaning import fuzzy_distinct_sessions, period_sessions
from noonday.operators.periods import (
    REPORT_RANGES, WINDOW, effective_days, enough_days, fanned_days, guard_settings, runs_text, settings_runs, window_days,
)
from noonday.operators.rollup import SAME_LEAK, ahi_of_day, histogram_percentile, merge_histograms, minutes_at
from noonday.sources.sinks import keep

# Fixed values.
COMPLIANT_HOURS = 4.0
MIN_COVERAGE, MAX_COVERAGE = 70.0, 105.0
MIN_LEAK_MINUTES = 1.0
USAGE_WEIGHTED_LOADER = r"(?i)^resvent\s*/\s*hoffrichter$"
RATES = {"ahi": "ahi_day", "residual": "residual_day", "central": "central_day", "rera": "rera_day"}
PRESSURES = ("pressure", "ipap", "epap")


def usage_weighted_policy(loader: Column) -> Column:
    """Loaders whose daily rates are averaged by usage and whose daily 95th percentiles are averaged."""
    return F.trim(loader).rlike(USAGE_WEIGHTED_LOADER)


def _mean_of(field: str) -> Column:
    return F.when(F.col(f"{field}_n") > 0, F.col(f"{field}_sum") / F.col(f"{field}_n"))


def day_values(days: DataFrame) -> DataFrame:
    """One value per metric and day out of the mergeable day aggregates."""
    return days.withColumns(
        {
            "usage_day": F.when(F.col("usage_hours_n") > 0, F.least(F.lit(24.0), F.col("usage_hours_sum"))),
            "ahi_day": ahi_of_day(),
            "residual_day": _mean_of("residual_apneas"),
            "central_day": _mean_of("central_apneas"),
            "rera_day": _mean_of("rera_index"),
            "leak_day": _mean_of("leak"),
            "leak_95_day": _mean_of("leak_95"),
            **{f"{p}_avg_day": _mean_of(f"{p}_avg") for p in PRESSURES},
            **{f"{p}_95_day": _mean_of(f"{p}_95") for p in PRESSURES},
            "vt_day": F.when(F.col("vt_n") > 0, F.col("vt_sum") / F.col("vt_n")),
            "rr_day": F.when(F.col("rr_n") > 0, F.col("rr_sum") / F.col("rr_n")),
        }
    )


def p95(value: str) -> Column:
    return F.percentile(value, F.lit(0.95))


def usage_metrics() -> dict[str, Column]:
    return {
        "days_with_data": F.count(F.lit(1)),
        "days_with_usage": F.count("usage_day"),
        "avg_usage_hours": F.avg("usage_day"),
        "daily_hours": F.coalesce(F.sum("usage_day"), F.lit(0.0)),
        "usage_compliant_days": F.count_if(F.col("usage_day") >= COMPLIANT_HOURS),
    }


def rate_metrics() -> dict[str, Column]:
    out = {}
    for name, day in RATES.items():
        hours = F.when((F.col("usage_day") > 0) & F.col(day).isNotNull(), F.col("usage_day"))
        out[f"{name}_mean"] = F.avg(day)
        out[f"{name}_95"] = p95(day)
        out[f"{name}_weighted"] = F.try_divide(F.sum(F.col(day) * hours), F.sum(hours))
    # AHI is weighted by the hours of the records themselves; days without such hours only count without weights.
    plain = F.when(F.coalesce("ahi_weight_hours", F.lit(0.0)) <= 0, F.col("ahi_day"))
    out["ahi_weighted"] = F.coalesce(
        F.try_divide(F.sum("ahi_weighted_sum"), F.nullif(F.sum("ahi_weight_hours"), F.lit(0.0))), F.avg(plain)
    )
    return out


def leak_metrics() -> dict[str, Column]:
    ok_pair = F.col("leak_max").isNotNull() & F.col("max_leak_minutes").isNotNull()
    ok_run = F.col("sustained_leak_max").isNotNull() & F.col("sustained_leak_minutes").isNotNull()
    top = F.struct(F.col("leak_max").alias("leak"), F.col("max_leak_minutes").alias("minutes"))
    run = F.struct(F.col("sustained_leak_max").alias("leak"), F.col("sustained_leak_minutes").alias("minutes"))
    long_top = F.max(F.when(ok_pair & (F.col("max_leak_minutes") >= MIN_LEAK_MINUTES), top))
    long_run = F.max(F.when(ok_run & (F.col("sustained_leak_minutes") >= MIN_LEAK_MINUTES), run))
    longest = F.max(
        F.when(ok_run, F.struct(F.col("sustained_leak_minutes").alias("minutes"), F.col("sustained_leak_max").alias("leak")))
    )
    return {
        "leak_mean": F.avg("leak_day"),
        "leak_95": F.coalesce(F.avg("leak_95_day"), p95("leak_day")),
        "leak_95_method": F.when(F.count("leak_95_day") > 0, "mean-daily-95").when(
            F.count("leak_day") > 0, "95-daily-summary"
        ),
        "max_leak": F.max("leak_max"),
        "max_leak_30m": F.max("leak_max_30m"),
        "max_leak_60m": F.max("leak_max_60m"),
        "n_leak_values": F.count("leak_day") + F.count("leak_95_day") + F.count("leak_max"),
        # Pairs near the maximum are compared once the maximum is known; a day gives at most one pair.
        "leak_pairs": F.collect_set(F.when(ok_pair, top)),
        "one_minute": F.greatest(long_top, long_run),
        "longest": longest,
    }


def pressure_metrics() -> dict[str, Column]:
    out = {}
    for p in PRESSURES:
        out[f"{p}_mean"] = F.avg(f"{p}_avg_day")
        out[f"{p}_95_of_95"] = p95(f"{p}_95_day")
        out[f"{p}_mean_of_95"] = F.avg(f"{p}_95_day")
        out[f"{p}_95_of_mean"] = p95(f"{p}_avg_day")
        out[f"{p}_95_days"] = F.count(f"{p}_95_day")
        out[f"{p}_days"] = F.count(f"{p}_avg_day")
    return out


def ventilation_metrics() -> dict[str, Column]:
    return {
        "vt_mean": F.avg("vt_day"), "vt_min": F.min("vt_min"), "vt_max": F.max("vt_max"),
        "rr_mean": F.avg("rr_day"), "rr_min": F.min("rr_min"),
    }


def method_flags() -> dict[str, Column]:
    out = {}
    for name, field in (("residual", "residual_apneas"), ("central", "central_apneas"), ("rera", "rera_index")):
        out[f"{name}_has_hours"] = F.bool_or((F.col("usage_hours_sum") > 0) & (F.col(f"{field}_n") > 0))
    out["ahi_has_hours"] = F.sum("ahi_weight_hours") > 0
    return out


def selected_days(
    days: DataFrame, windows: DataFrame | Sequence[int], history: DataFrame | None = None
) -> DataFrame:
    """Day values of every report window after the history clamp and the settings guard.

    ``windows`` is a table of windows, or the ranges that end at each card's latest day.
    """
    if isinstance(windows, DataFrame):
        inside = window_days(days, windows, history)
    else:
        inside = fanned_days(days, windows, history)
    return day_values(guard_settings(inside))


def report_metrics(
    days: DataFrame, windows: DataFrame | Sequence[int] = REPORT_RANGES, policy: Column | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """All day-based metrics per card and window, for all ranges in one job.

    Rows per (card, range, kind) are days, at most the length of the range; the heavy reduction happened in the day
    roll-up before.
    """
    weighted = policy if policy is not None else F.lit(False)
    chosen = selected_days(days, windows, history)
    grouped = chosen.groupBy(*WINDOW, "window_end").agg(
        F.min("effective_start").alias("effective_start"),
        F.bool_or("guarded").alias("guarded"),
        *[
            c.alias(n)
            for n, c in {
                **usage_metrics(), **rate_metrics(), **leak_metrics(), **pressure_metrics(),
                **ventilation_metrics(), **method_flags(),
            }.items()
        ],
    )
    n_days = effective_days(F.col("effective_start"), F.col("window_end"), F.col("range_days"))
    sized = grouped.withColumn("days_in_window", n_days).withColumn(
        "days_with_data", F.least("days_with_data", "days_in_window")
    )
    kept = sized.where(enough_days(F.col("range_days"), F.col("days_in_window")) | (F.col("kind") != "current"))

    near_max = F.filter("leak_pairs", lambda p: F.abs(p["leak"] - F.col("max_leak")) < SAME_LEAK)
    columns = {
        "usage_days_percent": F.col("days_with_usage") / F.col("days_in_window") * 100,
        "max_leak_minutes": F.array_max(F.transform(near_max, lambda p: p["minutes"])),
        "max_leak_one_minute": F.col("one_minute.leak"),
        "max_leak_one_minute_minutes": F.col("one_minute.minutes"),
        "sustained_leak_max": F.col("longest.leak"),
        "sustained_leak_minutes": F.col("longest.minutes"),
        "avg_ahi": F.when(weighted, F.col("ahi_weighted")).otherwise(F.col("ahi_mean")),
        "ahi_method": F.when(weighted & F.col("ahi_has_hours"), "usage-weighted").otherwise("daily-mean"),
        "shown_start": F.col("effective_start"),
        "shown_end": F.date_sub("window_end", 1),
    }
    for name in ("residual", "central", "rera"):
        columns[f"avg_{name}"] = F.when(
            weighted, F.coalesce(F.col(f"{name}_weighted"), F.col(f"{name}_mean"))
        ).otherwise(F.col(f"{name}_mean"))
        columns[f"{name}_method"] = F.when(weighted & F.col(f"{name}_has_hours"), "usage-weighted").otherwise("daily-mean")
    for p in PRESSURES:
        of_95 = F.when(weighted, F.col(f"{p}_mean_of_95")).otherwise(F.col(f"{p}_95_of_95"))
        columns[f"{p}_95"] = F.coalesce(of_95, F.col(f"{p}_95_of_mean"))
        columns[f"{p}_95_method"] = (
            F.when(F.col(f"{p}_95_days") > 0, F.when(weighted, "mean-daily-95").otherwise("95-daily-95"))
            .when(F.col(f"{p}_days") > 0, "95-daily-summary")
        )
    drop = ["leak_pairs", "one_minute", "longest"]
    return kept.withColumns(columns).drop(*drop)


def histogram_metrics(bins: DataFrame, chosen_days: DataFrame, extremes: DataFrame) -> DataFrame:
    """Tidal-volume median, minutes at its extremes and the 95th respiratory rate per window.

    ``bins``: card_id, clinical_day, channel, bin, n, seconds.
    """
    keys = list(WINDOW)
    in_window = bins.join(chosen_days.select(*keys, "clinical_day"), ["card_id", "clinical_day"])
    merged = merge_histograms(in_window, [*keys, "channel"])
    joined = merged.join(extremes.select(*keys, "vt_min", "vt_max"), keys)
    vt, rr = F.col("channel") == "vt", F.col("channel") == "rr"
    vt_bins = joined.where(vt).groupBy(*keys).agg(
        histogram_percentile(0.5).alias("vt_median"),
        minutes_at(F.col("vt_min")).alias("vt_min_minutes"),
        minutes_at(F.col("vt_max")).alias("vt_max_minutes"),
    )
    rr_bins = joined.where(rr).groupBy(*keys).agg(histogram_percentile(0.95).alias("rr_95"))
    return vt_bins.join(rr_bins, keys, "full_outer")


PERIOD = ("card_id", "kind")


def timing_metrics(metrics: DataFrame, sessions: DataFrame, periods: DataFrame) -> DataFrame:
    """Principal and nap hours, the timing gate and the compliance that follows from it.

    ``sessions``: card_id, start_ts, end_ts, source_clinical_day (NULL where the source names no day).  ``periods``: the
    settings periods of each card.  Sessions fan out to the periods they lie in; profile and drift are inferred from a
    period's own sessions, and a window classifies the sessions of its period whose day (the source's, else the clinical
    one) lies inside.  Near duplicates go in each of these sets on its own.  Timing counts only if session hours cover 70
    to 105 percent of the reported hours.
    """
    keys = list(WINDOW)
    own = keep(period_sessions(sessions, periods).select(*PERIOD, "start_ts", "end_ts", "source_clinical_day"), "period-sessions")
    profiles = sleep.sleep_profiles(keep(fuzzy_distinct_sessions(own, keys=PERIOD), "distinct-sessions"), PERIOD)
    day = F.coalesce("source_clinical_day", clinical_day("start_ts"))
    windows = metrics.select(*keys, "effective_start", "window_end")
    in_window = own.join(windows, list(PERIOD)).where((day >= F.col("effective_start")) & (day < F.col("window_end")))
    placed = sleep.with_sleep_day(fuzzy_distinct_sessions(in_window, keys=keys), profiles, PERIOD)
    totals = sleep.classify_totals(sleep.classify_days(placed, keys), keys)
    shown = profiles.select(*PERIOD, "confidence", "drift", "anchor_minutes", "window_end_minutes")
    joined = metrics.join(totals, keys, "left").join(shown, list(PERIOD), "left")
    session_hours = F.coalesce("total_minutes", F.lit(0.0)) / 60
    raw = F.when(F.col("daily_hours") > 0, session_hours / F.col("daily_hours") * 100).otherwise(0.0)
    return with_timing(joined, session_hours, raw)


def with_timing(joined: DataFrame, session_hours: Column, raw_coverage: Column) -> DataFrame:
    usable = (
        F.col("n_sleep_days").isNotNull()
        & (F.round(raw_coverage, 9) >= MIN_COVERAGE)
        & (F.round(raw_coverage, 9) <= MAX_COVERAGE)
    )
    total = sleep.steady(F.when(F.col("timed"), F.greatest("daily_hours", "session_hours")).otherwise(F.col("daily_hours")))
    per_day = F.nullif("timed_days", F.lit(0))
    return (
        joined.withColumns({"session_hours": session_hours, "raw_coverage": sleep.steady(raw_coverage), "timed": usable})
        .withColumns(
            {
                "total_hours": total,
                "principal_hours": F.when(F.col("timed"), sleep.steady(F.col("principal_minutes") / 60)),
                "nap_hours": F.when(F.col("timed"), sleep.steady(F.col("nap_minutes") / 60)),
                "compliant_days": F.when(
                    F.col("timed"), F.least("days_in_window", "timed_compliant_days")
                ).otherwise(F.col("usage_compliant_days")),
            }
        )
        .withColumns(
            {
                "unclassified_hours": F.when(
                    F.col("timed"), sleep.steady(F.greatest(F.lit(0.0), F.col("total_hours") - F.col("session_hours")))
                ),
                "avg_principal_hours": sleep.steady(F.col("principal_hours") / per_day),
                "avg_nap_hours": sleep.steady(F.col("nap_hours") / per_day),
                "compliance_percent": sleep.steady(F.col("compliant_days") / F.col("days_in_window") * 100),
            }
        )
    )


# The warning texts of a report.
W_PRINCIPAL = (
    "CMS 4+ correlation uses the inferred principal therapy episode for each patient-specific sleep day; separate "
    "suspected naps are excluded and therapy interruptions of up to 30 minutes are grouped."
)
W_DRIFT = (
    "The patient's recent therapy timing differs from the earlier imported pattern; the inferred sleep window is "
    "low-confidence and should be clinically reviewed."
)
W_LOW = "The inferred sleep window has low confidence because therapy start times were inconsistent."
W_NO_TIMING = (
    "Session-level timing was unavailable or incomplete for this report; 4+ usage uses device-reported daily totals, "
    "which may include naps."
)
W_NO_USAGE = "Usage-hour fields were not found in the selected data. Compliance metrics are shown as 0."
W_NO_AHI = "AHI metrics were not detected from the selected files."
W_NO_LEAK = "Leak metrics were not detected from the selected files."
W_NO_DEVICE = "Machine device/model could not be confidently detected from uploaded files."
W_REVIEW = "Historical therapy period for review only. Export is unavailable."


W_ANCHORED = "Latest available therapy data ended on {}; calculations were anchored to the latest available clinical day instead of today."
W_GUARD = (
    "Therapy settings changed within the {}-day report window ({}). Calculations were limited to {} from {} forward to avoid mixing therapy settings."
)
W_DUPLICATES = "Deduplicated {} overlapping daily records."
W_LATE_SETTINGS = "The latest {} settings record is dated after the last therapy {}; settings shown may not describe the report period."

#: The order in which a report lists its warnings; those of the import come before those of the window.
RANKS = {
    code: rank
    for rank, code in enumerate(
        (
            "mixed_layouts", "loader", "late_settings", "duplicates", "settings_changed", "anchored", "guarded", "review", "short_history",
            "principal", "drift", "low_confidence", "over_reported", "no_timing", "no_usage", "no_ahi", "no_leak", "no_device",
        ),
        1,
    )
}
#: Import warnings that a report of the previous settings period leaves out.
CURRENT_ONLY = ("settings_changed",)


def text_of(form: str, *values: Column | str) -> Column:
    """``form`` with its braces filled; NULL as soon as a value is NULL."""
    parts = form.split("{}")
    filled = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        filled += [(F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(part)]
    return F.concat(*filled)


def warning_row(code: str, text: Column) -> Column:
    return F.struct(F.lit(RANKS[code]).alias("rank"), F.lit(code).alias("code"), text.alias("text"))


def card_warning(code: str, rows: DataFrame, text: Column | str = "warning") -> DataFrame:
    """Rows of a warning that holds for all reports of a card: ``card_id``, ``rank``, ``code``, ``text``."""
    said = F.col(text) if isinstance(text, str) else text
    return rows.select("card_id", F.inline(F.array(warning_row(code, said)))).where("text IS NOT NULL")


def duplicate_warning(records: DataFrame, distinct: DataFrame) -> DataFrame:
    """``distinct``: the records kept, each with the number of its ``copies``."""
    gone = distinct.groupBy("card_id").agg(F.sum(F.col("copies") - 1).alias("gone")).where("gone > 0")
    return card_warning("duplicates", gone, text_of(W_DUPLICATES, "gone"))


def guard_warning(days: DataFrame, windows: DataFrame) -> DataFrame:
    """``card_id``, ``range_days``, ``kind``, ``guard_text`` of windows with more than one settings run."""
    runs = settings_runs(window_days(days.select("card_id", "clinical_day", "signature", "label"), windows), WINDOW)
    last = runs.groupBy(*WINDOW).agg(F.max_by(F.struct("label", "start_day"), "run").alias("last"), F.countDistinct("signature").alias("n_signatures"))
    text = text_of(W_GUARD, "range_days", "text", "last.label", human_date("last.start_day"))
    return runs_text(runs, WINDOW).join(last.where("n_signatures > 1"), list(WINDOW)).select(*WINDOW, text.alias("guard_text"))


def window_warnings(metrics: DataFrame, device: Column | None = None) -> DataFrame:
    """Typed warnings of each report row (see :func:`timing_metrics` for its columns), one row each.

    ``metrics`` may tell the text for a guarded window (``guard_text``) and, for one moved to the card's last data, the
    ``anchored_day``.
    """
    timed, n, days = F.col("timed"), F.col("days_in_window"), F.col("range_days")
    short = text_of(
        "Only {} days of therapy history are available; calculations were adjusted from {} days to avoid false deficits.", n, days
    )
    over = text_of(
        "Session intervals exceeded device-reported therapy by {}%; sleep timing was not inferred from inconsistent source data.",
        F.floor(F.round(F.col("raw_coverage") - 100, 9) + 0.5),
    )
    has_hours = F.col("daily_hours") > 0
    drift = F.coalesce("drift", F.lit(False))
    missing_device = F.lit(False) if device is None else device.isNull() | (F.trim(device) == "")
    given = lambda c, kind: F.col(c) if c in metrics.columns else F.lit(None).cast(kind)
    no_leak = (
        (F.col("n_leak_values") == 0) & F.col("max_leak_30m").isNull() & F.col("max_leak_60m").isNull()
        & F.col("sustained_leak_minutes").isNull()
    )
    items = {
        "anchored": text_of(W_ANCHORED, human_date(given("anchored_day", "date"))),
        "guarded": F.when(F.col("guarded"), given("guard_text", "string")),
        "review": F.when(F.col("kind") == "previous", W_REVIEW),
        "short_history": F.when(n < days, short),
        "principal": F.when(timed, W_PRINCIPAL),
        "drift": F.when(timed & drift, W_DRIFT),
        "low_confidence": F.when(timed & ~drift & (F.col("confidence") == "low"), W_LOW),
        "over_reported": F.when(~timed & has_hours & (F.round("raw_coverage", 9) > MAX_COVERAGE), over),
        "no_timing": F.when(~timed & has_hours, W_NO_TIMING),
        "no_usage": F.when(F.col("days_with_usage") == 0, W_NO_USAGE),
        "no_ahi": F.when(F.col("ahi_mean").isNull(), W_NO_AHI),
        "no_leak": F.when(no_leak, W_NO_LEAK),
        "no_device": F.when(missing_device, W_NO_DEVICE),
    }
    rows = F.array(*[warning_row(code, text) for code, text in items.items()])
    return metrics.select(*WINDOW, F.inline(rows)).where("text IS NOT NULL")


def with_warnings(metrics: DataFrame, context: DataFrame | None = None, device: Column | None = None) -> DataFrame:
    """``metrics`` with ``warnings``, the texts of the card's ``context`` and of the window in the order of their rank."""
    rows = window_warnings(metrics, device)
    if context is not None:
        reports = metrics.select(*WINDOW)
        told = reports.join(context, "card_id").where((F.col("kind") == "current") | ~F.col("code").isin(*CURRENT_ONLY))
        rows = rows.unionByName(told.select(*WINDOW, "rank", "code", "text"))
    listed = rows.groupBy(*WINDOW).agg(F.array_sort(F.collect_list(F.struct("rank", "code", "text"))).alias("listed"))
    joined = metrics.join(listed, list(WINDOW), "left")
    return joined.withColumn("warnings", F.coalesce(F.col("listed.text"), F.array().cast("array<string>"))).drop("listed")


def finite(value: Column) -> Column:
    """Zero for a value that is not finite; NULL stays NULL."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def device_text(device: Column) -> Column:
    """Device name without its trailing card note; a default text when there is none."""
    bare = F.trim(F.regexp_replace(device, r"(?i)\s*\(\s*sd\s*card\s*\)\s*$", ""))
    return F.when(F.coalesce(bare, F.lit("")) == "", "Not detected from input files").otherwise(bare)


def final_projection(metrics: DataFrame, device: Column) -> DataFrame:
    """Report columns as delivered: finite numbers, shown dates as text, device text."""
    numbers = [f.name for f in metrics.schema.fields if f.dataType.typeName() == "double"]
    return metrics.withColumns(
        {
            **{c: finite(F.col(c)) for c in numbers},
            "device": device_text(device),
            "date_range_start": human_date("shown_start"),
            "date_range_end": human_date("shown_end"),
        }
    )
