"""Settings runs and periods, report windows and range fan-out.

Everything here works on day rows: a card has at most one per calendar day, so a window over a card is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonday.functions.dates import human_date, local_noon

# Fixed values of the report ranges.
DEFAULT_LOOKBACK_DAYS = 90
REPORT_RANGES = (90, 60, 30, 7)
PERIOD_DAYS = 90
VISIBLE_RUNS = 4


# --- settings runs ---------------------------------------------------------------------------------------------


def settings_runs(days: DataFrame, keys: Sequence[str] = ("card_id",)) -> DataFrame:
    """Runs of consecutive day rows with one signature; days without a signature are skipped, gaps do not break."""
    keys = list(keys)
    ordered = Window.partitionBy(*keys).orderBy("clinical_day")
    signed = days.where(F.length(F.trim("signature")) > 0)
    changed = F.coalesce(F.lag("signature").over(ordered) != F.col("signature"), F.lit(True))
    numbered = signed.withColumn("run", F.sum(changed.cast("bigint")).over(ordered))
    aggs = [
        F.min("clinical_day").alias("start_day"),
        F.max("clinical_day").alias("end_day"),
        F.min_by("signature", "clinical_day").alias("signature"),
        F.min_by("label", "clinical_day").alias("label"),
        F.count(F.lit(1)).alias("signed_days"),
    ]
    if "machine" in days.columns:
        aggs.append(
            F.min_by("machine", F.when(F.col("machine").isNotNull(), F.col("clinical_day"))).alias("machine")
        )
    # The window above and this aggregate share one partitioning by card.
    return numbered.groupBy(*keys, "run").agg(*aggs)


def settings_periods(days: DataFrame, max_days: int = PERIOD_DAYS) -> DataFrame:
    """Last two runs of a card as its current and previous period, at most ``max_days`` long."""
    newest = Window.partitionBy("card_id").orderBy(F.desc("run"))
    last_two = (
        settings_runs(days)
        .withColumn("rank", F.row_number().over(newest))
        .where("rank <= 2")
        .select(
            "card_id",
            F.when(F.col("rank") == 1, "current").otherwise("previous").alias("kind"),
            "signature",
            "label",
            F.greatest("start_day", F.date_sub("end_day", max_days - 1)).alias("period_start"),
            F.col("end_day").alias("period_end"),
        )
    )
    counted = (
        last_two.join(days.select("card_id", "clinical_day"), "card_id")
        .where(F.col("clinical_day").between(F.col("period_start"), F.col("period_end")))
        .groupBy("card_id", "kind")
        .agg(F.count(F.lit(1)).alias("days_with_data"))
    )
    return last_two.join(counted, ["card_id", "kind"])


def runs_text(runs: DataFrame, keys: Sequence[str] = ("card_id",), visible: int = VISIBLE_RUNS) -> DataFrame:
    """Last runs of a group as one text, with a prefix counting the earlier ones."""
    start, end = human_date("start_day"), human_date("end_day")
    one = F.when(F.col("start_day") == F.col("end_day"), F.concat("label", F.lit(" on "), start)).otherwise(
        F.concat("label", F.lit(" from "), start, F.lit(" to "), end)
    )
    listed = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", one.alias("text")))).alias("runs"))
    n = F.size("runs")
    texts = F.transform("runs", lambda r: r["text"])
    shown = F.slice(texts, F.greatest(F.lit(1), n - (visible - 1)), visible)
    prefix = F.when(
        n > visible, F.concat(F.lit("... "), (n - visible).cast("string"), F.lit(" earlier setting period(s); "))
    ).otherwise("")
    return listed.select(*keys, n.cast("bigint").alias("n_runs"), F.concat(prefix, F.array_join(shown, "; ")).alias("text"))


def change_warning(days: DataFrame, imported_days: int) -> DataFrame:
    """Warning text of cards with more than one signature in the imported history."""
    runs = settings_runs(days)
    latest = runs.groupBy("card_id").agg(
        F.countDistinct("signature").alias("n_signatures"),
        F.max_by(F.struct("label", "start_day"), "run").alias("last"),
    )
    text = F.concat(
        F.lit(f"Therapy settings changed during the imported {imported_days}-day history. "
              "Reports use the latest settings period: "),
        F.col("last.label"), F.lit(" since "), human_date("last.start_day"), F.lit("."),
    )
    return latest.where("n_signatures > 1").select("card_id", "n_signatures", text.alias("warning"))


# --- windows ---------------------------------------------------------------------------------------------------


def lookback_days(value: Column, maximum: Column | None = None) -> Column:
    """Whole days; 90 for a missing, non-finite or non-positive value; at most the prepared maximum."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 1e15) & (value >= 1)
    days = F.when(ok, F.floor(F.when(ok, value))).otherwise(F.lit(DEFAULT_LOOKBACK_DAYS)).cast("bigint")
    return days if maximum is None else F.least(days, maximum)


def window_to_now(now: Column, offset_minutes: Column, days: Column | int) -> tuple[Column, Column]:
    """[noon today at the offset - N days, noon today), as first day and first day after."""
    end = F.to_date(local_noon(now, offset_minutes))
    return F.date_sub(end, days), end


def window_to_latest(latest: Column, days: Column | int) -> tuple[Column, Column]:
    end = F.date_add(latest, 1)
    return F.date_sub(end, days), end


def window_to_label(end_label: Column, days: Column | int) -> tuple[Column, Column]:
    """The given end day is the first day after the window."""
    return F.date_sub(end_label, days), end_label


def clamp_start(start: Column, end: Column, first_day: Column, history_start: Column) -> Column:
    """Window start moved up to the first known day, if that lies before the window end."""
    known = F.least(F.when(first_day < end, first_day), F.when(history_start < end, history_start))
    return F.greatest(start, known)


def latest_days(record_days: DataFrame, path_days: DataFrame) -> DataFrame:
    """Newest clinical day per card over records and dated paths."""
    both = record_days.select("card_id", F.col("clinical_day").alias("day")).unionByName(
        path_days.select("card_id", F.col("record_date").alias("day"))
    )
    return both.groupBy("card_id").agg(F.max("day").alias("latest_day"))


def fan_out(days: DataFrame, ranges: Sequence[int] = REPORT_RANGES, kind: str = "current") -> DataFrame:
    """One window per card and report range, all ending after the card's latest day."""
    latest = days.groupBy("card_id").agg(F.max("clinical_day").alias("latest_day"))
    end = F.date_add("latest_day", 1)
    return (
        latest.withColumn("range_days", F.explode(F.array(*[F.lit(r) for r in ranges])))
        .select(
            "card_id", "range_days", F.lit(kind).alias("kind"),
            F.date_sub(end, F.col("range_days")).alias("window_start"), end.alias("window_end"),
        )
    )


def previous_windows(periods: DataFrame, ranges: Sequence[int] = (PERIOD_DAYS,)) -> DataFrame:
    """Window of the earlier settings period: it ends the day after the period's last day."""
    end = F.date_add("period_end", 1)
    return (
        periods.where("kind = 'previous'")
        .withColumn("range_days", F.explode(F.array(*[F.lit(r) for r in ranges])))
        .select(
            "card_id", "range_days", "kind",
            F.date_sub(end, F.col("range_days")).alias("window_start"), end.alias("window_end"),
        )
    )


WINDOW = ("card_id", "range_days", "kind")


def window_days(days: DataFrame, windows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Day rows of every window, with the window start moved up to the first known day of the card."""
    first = days.groupBy("card_id").agg(F.min("clinical_day").alias("first_day"))
    bounds = windows.join(first, "card_id")
    if history is not None:
        bounds = bounds.join(history.select("card_id", "history_start"), "card_id", "left")
    else:
        bounds = bounds.withColumn("history_start", F.lit(None).cast("date"))
    start = clamp_start(F.col("window_start"), F.col("window_end"), F.col("first_day"), F.col("history_start"))
    bounds = bounds.withColumn("effective_start", start).drop("first_day", "history_start")
    return bounds.join(days, "card_id").where(
        (F.col("clinical_day") >= F.col("effective_start")) & (F.col("clinical_day") < F.col("window_end"))
    )


def fanned_days(
    days: DataFrame, ranges: Sequence[int] = REPORT_RANGES, history: DataFrame | None = None, kind: str = "current"
) -> DataFrame:
    """:func:`window_days` over :func:`fan_out`, from one reading of the day rows.

    The card's first and latest day come from a window over its day rows, so the days are not read again to find them.
    """
    card = Window.partitionBy("card_id")
    placed = days.withColumns(
        {"__latest": F.max("clinical_day").over(card), "__first": F.min("clinical_day").over(card)}
    )
    if history is not None:
        placed = placed.join(history.select("card_id", F.col("history_start").alias("__history")), "card_id", "left")
    else:
        placed = placed.withColumn("__history", F.lit(None).cast("date"))
    fanned = placed.where(F.col("clinical_day") > F.date_sub("__latest", max(ranges))).withColumn(
        "range_days", F.explode(F.array(*[F.lit(r) for r in ranges]))
    )
    end = F.date_add("__latest", 1)
    bounded = fanned.withColumns(
        {"kind": F.lit(kind), "window_start": F.date_sub(end, F.col("range_days")), "window_end": end}
    )
    start = clamp_start(F.col("window_start"), F.col("window_end"), F.col("__first"), F.col("__history"))
    return bounded.withColumn("effective_start", start).drop("__latest", "__first", "__history").where(
        F.col("clinical_day") >= F.col("effective_start")
    )


def guard_settings(in_window: DataFrame, keys: Sequence[str] = WINDOW) -> DataFrame:
    """Limit a window to its latest settings run, if the signature changes inside it.

    Days without a signature inside the run stay.  ``guarded`` tells whether the window shrank.
    """
    whole = Window.partitionBy(*keys)
    signed = F.when(F.length(F.trim("signature")) > 0, F.trim("signature"))
    step1 = in_window.withColumn("__sig", signed).withColumn(
        "__last", F.max_by("__sig", F.when(F.col("__sig").isNotNull(), F.col("clinical_day"))).over(whole)
    )
    step2 = step1.withColumn(
        "__other", F.max(F.when(F.col("__sig") != F.col("__last"), F.col("clinical_day"))).over(whole)
    )
    step3 = step2.withColumn(
        "__run", F.min(F.when(F.col("__sig").isNotNull() & (F.col("clinical_day") > F.col("__other")),
                              F.col("clinical_day"))).over(whole)
    )
    guarded = F.col("__other").isNotNull()
    return (
        step3.withColumn("guarded", guarded)
        .withColumn("effective_start", F.when(guarded, F.col("__run")).otherwise(F.col("effective_start")))
        .where(~F.col("guarded") | (F.col("clinical_day") >= F.col("__run")))
        .drop("__sig", "__last", "__other", "__run")
    )


def effective_days(start: Column, end: Column, range_days: Column) -> Column:
    span = F.greatest(F.lit(0), F.datediff(end, start))
    return F.greatest(F.lit(1), F.least(range_days, span)).cast("bigint")


def enough_days(range_days: Column, days_in_window: Column, smallest: int = min(REPORT_RANGES)) -> Column:
    """A range is reported if its window is full; the smallest range always is."""
    return (days_in_window >= range_days) | (range_days == smallest)


def windows_with_fallback(days: DataFrame, now: Column, offset_minutes: Column, ranges: int | Sequence[int]) -> DataFrame:
    """Windows to now per card and range, or to the card's latest day where the first holds no day.

    ``anchored_day`` is that latest day where a window was moved.
    """
    ranges = (ranges,) if isinstance(ranges, int) else tuple(ranges)
    inside = lambda n: (F.col("clinical_day") >= window_to_now(now, offset_minutes, n)[0]) & (
        F.col("clinical_day") < window_to_now(now, offset_minutes, n)[1]
    )
    recent = F.array(*[F.struct(F.lit(n).alias("range_days"), F.count_if(inside(n)).alias("n_recent")) for n in ranges])
    card = days.groupBy("card_id").agg(F.max("clinical_day").alias("latest_day"), recent.alias("recent"))
    each = card.select("card_id", "latest_day", F.inline("recent"))
    start, end = window_to_now(now, offset_minutes, F.col("range_days"))
    late_start, late_end = window_to_latest(F.col("latest_day"), F.col("range_days"))
    here = F.col("n_recent") > 0
    return each.select(
        "card_id", "range_days",
        F.lit("current").alias("kind"),
        F.when(here, start).otherwise(late_start).alias("window_start"),
        F.when(here, end).otherwise(late_end).alias("window_end"),
        (~here).alias("anchored_to_latest"),
        F.when(~here, F.col("latest_day")).alias("anchored_day"),
    )


# --- the machine of a report -----------------------------------------------------------------------------------

# What a column of the machine is.  Identity and settings are inherited from the import or from the settings
# period; a measured value is never inherited, it comes from the days of the report's own window or is missing.
MACHINE_ROLES = {
    "device": "identity", "serial": "identity",
    **dict.fromkeys(
        ("mode", "pressure", "pressure_min", "pressure_max", "pressure_auto", "epap", "ipap", "respiratory_rate", "tidal_volume", "ramp_time", "ramp_pressure", "pressure_relief"),
        "setting",
    ),
    **dict.fromkeys(
        (
            "pressure_mean", "pressure_95", "ipap_mean", "ipap_95", "epap_mean", "epap_95", "vt_mean", "vt_min", "vt_min_minutes", "vt_median", "vt_max",
            "vt_max_minutes", "rr_mean", "rr_min", "rr_95",
        ),
        "measured",
    ),
}


def report_machine(reports: DataFrame, imported: DataFrame, of_period: DataFrame) -> DataFrame:
    """Reports with the machine's columns, each by its role.

    ``reports``: card_id, kind and what was measured in the window.  ``imported``: one row per card with its newest device and
    settings.  ``of_period``: card_id, kind and the settings of the period.  A report of the current period has the import's
    identity and settings, one of the previous period its period's settings and the import's identity where the period
    has none of its own.  Measured columns of the import or the period are dropped.
    """
    named = {c for side in (imported, of_period) for c in side.columns} & set(MACHINE_ROLES)
    kinds = {f.name: f.dataType for side in (of_period, imported) for f in side.schema.fields}
    joined = reports.alias("r").join(imported.alias("i"), "card_id", "left").join(of_period.alias("p"), ["card_id", "kind"], "left")
    columns = {}
    for name in sorted(named):
        nothing = F.lit(None).cast(kinds[name])
        new, own = (F.col(f"{a}.`{name}`") if name in side.columns else nothing for a, side in (("i", imported), ("p", of_period)))
        role = MACHINE_ROLES[name]
        if role == "measured":
            if name not in reports.columns:
                columns[name] = nothing
        else:
            earlier = F.coalesce(own, new) if role == "identity" else own
            columns[name] = F.when(F.col("kind") == "previous", earlier).otherwise(new)
    kept = [F.col(f"r.`{c}`").alias(c) if c not in ("card_id", "kind") else F.col(c) for c in reports.columns if c not in columns]
    return joined.select(*kept, *[c.alias(n) for n, c in columns.items()])


# --- settings against therapy, summary against session ---------------------------------------------------------


def settings_after_therapy(latest_settings: Column, last_therapy: Column) -> Column:
    """The newest settings are dated more than a day after the last therapy day."""
    return F.datediff(latest_settings, last_therapy) > 1


def settings_conflict(summary_mode: Column, record_mode: Column) -> tuple[Column, Column]:
    """Mode to use and whether the two sources disagree: the newest record wins over the summary."""
    return F.coalesce(record_mode, summary_mode), F.coalesce(summary_mode != record_mode, F.lit(False))


def summary_or_session(records: DataFrame, is_summary: str = "is_summary") -> DataFrame:
    """If a card has any daily summary its session rows serve as timing only, else they are the records."""
    cards = records.groupBy("card_id").agg(F.bool_or(is_summary).alias("has_summary"))
    use = (
        F.when(F.col("has_summary") & F.col(is_summary), "record")
        .when(F.col("has_summary"), "timing")
        .otherwise("record")
    )
    return records.join(cards, "card_id").withColumn("use", use)
