"""Queries: report metrics, methods, warnings and rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day, shift_seconds
from noonday.operators import catalogue, periods, rollup
from noonday.operators.cleaning import RESPIRATORY_RATE, TIDAL_VOLUME, distinct_records, ranged, valid_sessions
from noonday.plans import adapters as a
from noonday.plans import report, rows
from noonday.plans.adapters import DAY_SETTINGS, RECORDS, with_views
from noonday.plans.q_catalogue import SELECT_VIEWS
from noonday.plans.q_catalogue import cat as catalogue_files
from noonday.plans.q_clean import DISTINCT_RECORDS, SETTINGS_PERIODS, coarse_records, walked
from noonday.plans.q_series import DOMINANT
from noonday.plans.q_sleep import ANCHOR, CLASSIFY, DRIFT, PROFILE
from noonday.plans.registry import query
from noonday.plans.sql_parts import DAYS, RECORD_DAYS, windowed
from noonday.session import checkpoint_dir
from noonday.sources import sinks
from noonday.sources.sinks import keep


def report_days(spark, sf):
    """Day buckets with the settings of the day (one signature per day in these records)."""
    records = a.records(spark, sf)
    settings = [F.min("settings_signature").alias("signature"), F.min("settings_label").alias("label")]
    return rollup.finish_days(rollup.day_parts(records, *settings), records)


@query(
    "report_flagship",
    with_views(*RECORD_DAYS, windowed((30, 7)), body="""
SELECT v.card_id, v.range_days, any_value(days_in_window) AS days_in_window,
  least(count(*), any_value(days_in_window)) AS days_with_data, count(usage_day) AS days_with_usage,
  round(avg(usage_day), 6) AS avg_usage_hours,
  round(100.0 * count(usage_day) / any_value(days_in_window), 6) AS usage_days_percent,
  count(*) FILTER (usage_day >= 4) AS usage_compliant_days,
  round(avg(ahi_day), 6) AS avg_ahi, round(quantile_cont(ahi_day, 0.95), 6) AS ahi_95,
  round(avg(residual_day), 6) AS avg_residual, round(avg(leak_day), 6) AS leak_mean,
  round(coalesce(avg(leak_95_day), quantile_cont(leak_day, 0.95)), 6) AS leak_95,
  round(max(leak_max), 6) AS max_leak, round(max(leak_max_30m), 6) AS max_leak_30m
FROM vals v JOIN sized USING (card_id, range_days) GROUP BY ALL"""),
    whole="range_days",
)
def report_flagship(spark, sf):
    days = report_days(spark, sf)
    metrics = report.report_metrics(days, (30, 7))
    return (
        metrics.select(
            "card_id", "range_days", "days_in_window", "days_with_data",
            "days_with_usage", "avg_usage_hours", "usage_days_percent", "usage_compliant_days", "avg_ahi", "ahi_95",
            "avg_residual", "leak_mean", "leak_95", "max_leak", "max_leak_30m",
        )
    )


METRICS = """
m AS (
  SELECT v.card_id, v.range_days, any_value(days_in_window) AS days_in_window, min(effective_start) AS effective_start,
    any_value(window_end) AS window_end, count(usage_day) AS days_with_usage,
    least(count(*), any_value(days_in_window)) AS days_with_data, avg(usage_day) AS avg_usage_hours,
    coalesce(sum(usage_day), 0) AS daily_hours, count(*) FILTER (usage_day >= 4) AS usage_compliant_days,
    avg(ahi_day) AS ahi_mean, quantile_cont(ahi_day, 0.95) AS ahi_95,
    coalesce(sum(ahi_weighted_sum) / nullif(sum(ahi_weight_hours), 0), avg(CASE WHEN coalesce(ahi_weight_hours, 0) <= 0 THEN ahi_day END)) AS ahi_weighted,
    avg(residual_day) AS residual_mean, quantile_cont(residual_day, 0.95) AS residual_95,
    coalesce(sum(CASE WHEN usage_day > 0 THEN residual_day * usage_day END) / nullif(sum(CASE WHEN usage_day > 0 AND residual_day IS NOT NULL THEN usage_day END), 0), avg(residual_day)) AS residual_weighted,
    avg(central_day) AS central_mean, quantile_cont(central_day, 0.95) AS central_95, avg(rera_day) AS rera_mean,
    avg(leak_day) AS leak_mean, coalesce(avg(leak_95_day), quantile_cont(leak_day, 0.95)) AS leak_95,
    CASE WHEN count(leak_95_day) > 0 THEN 'mean-daily-95' WHEN count(leak_day) > 0 THEN '95-daily-summary' END AS leak_95_method,
    max(leak_max) AS max_leak, max(leak_max_30m) AS max_leak_30m, max(leak_max_60m) AS max_leak_60m,
    avg(pressure_avg_day) AS pressure_mean, avg(ipap_avg_day) AS ipap_mean, avg(epap_avg_day) AS epap_mean,
    coalesce(quantile_cont(pressure_95_day, 0.95), quantile_cont(pressure_avg_day, 0.95)) AS pressure_95,
    coalesce(quantile_cont(ipap_95_day, 0.95), quantile_cont(ipap_avg_day, 0.95)) AS ipap_95,
    coalesce(quantile_cont(epap_95_day, 0.95), quantile_cont(epap_avg_day, 0.95)) AS epap_95,
    coalesce(avg(pressure_95_day), quantile_cont(pressure_avg_day, 0.95)) AS pressure_95_weighted,
    CASE WHEN count(epap_95_day) > 0 THEN '95-daily-95' WHEN count(epap_avg_day) > 0 THEN '95-daily-summary' END AS epap_95_method,
    avg(vt_day) AS vt_mean, min(vt_min) AS vt_min, max(vt_max) AS vt_max, avg(rr_day) AS rr_mean, min(rr_min) AS rr_min
  FROM vals v JOIN sized USING (card_id, range_days) GROUP BY v.card_id, v.range_days)"""
RANGES = (30, 14, 9, 7)
M_VIEWS = (*RECORD_DAYS, windowed(RANGES), METRICS)


def metrics_of(spark, sf, policy=None):
    return report.report_metrics(report_days(spark, sf), RANGES, policy)


@query(
    "usage_metrics",
    with_views(*M_VIEWS, body="""
SELECT card_id, range_days, days_in_window, days_with_data, days_with_usage, round(avg_usage_hours, 6) AS avg_usage_hours,
  round(daily_hours, 6) AS daily_hours, usage_compliant_days, round(100.0::DOUBLE * days_with_usage / days_in_window, 6) AS usage_days_percent,
  effective_start AS shown_start, window_end - 1 AS shown_end FROM m"""),
    whole="range_days days_in_window days_with_data", days="shown_start shown_end",
)
def usage_metrics(spark, sf):
    return metrics_of(spark, sf).select(
        "card_id", "range_days", "days_in_window", "days_with_data", "days_with_usage", "avg_usage_hours", "daily_hours",
        "usage_compliant_days", "usage_days_percent", "shown_start", "shown_end",
    )


@query(
    "rate_means",
    with_views(*M_VIEWS, body="""
SELECT card_id, range_days, round(ahi_mean, 6) AS avg_ahi, round(residual_mean, 6) AS avg_residual, round(central_mean, 6) AS avg_central,
  round(rera_mean, 6) AS avg_rera, round(ahi_95, 6) AS ahi_95, round(residual_95, 6) AS residual_95, round(central_95, 6) AS central_95 FROM m"""),
    whole="range_days",
)
def rate_means(spark, sf):
    return metrics_of(spark, sf).select(
        "card_id", "range_days", "avg_ahi", "avg_residual", "avg_central", "avg_rera", "ahi_95", "residual_95", "central_95"
    )


@query(
    "rate_usage_weighted",
    with_views(*M_VIEWS, body="""
SELECT card_id, range_days, round(ahi_weighted, 6) AS avg_ahi, round(residual_weighted, 6) AS avg_residual,
  round(pressure_95_weighted, 6) AS pressure_95 FROM m"""),
    whole="range_days",
)
def rate_usage_weighted(spark, sf):
    policy = report.usage_weighted_policy(F.lit(" Resvent / Hoffrichter "))
    return metrics_of(spark, sf, policy).select("card_id", "range_days", "avg_ahi", "avg_residual", "pressure_95")


@query(
    "leak_metrics",
    with_views(*M_VIEWS, body="""
, near AS (
  SELECT v.card_id, v.range_days, max(v.max_leak_minutes) AS minutes FROM vals v JOIN m USING (card_id, range_days)
  WHERE abs(v.leak_max - m.max_leak) < 0.001 GROUP BY v.card_id, v.range_days),
pairs AS (
  SELECT card_id, range_days, leak_max AS leak, max_leak_minutes AS minutes FROM vals WHERE max_leak_minutes >= 1
  UNION ALL SELECT card_id, range_days, sustained_leak_max, sustained_leak_minutes FROM vals WHERE sustained_leak_minutes >= 1),
one AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY card_id, range_days ORDER BY leak DESC, minutes DESC) = 1),
longest AS (SELECT * FROM vals WHERE sustained_leak_minutes IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY card_id, range_days ORDER BY sustained_leak_minutes DESC, sustained_leak_max DESC) = 1)
SELECT m.card_id, m.range_days, round(leak_mean, 6) AS leak_mean, round(leak_95, 6) AS leak_95, m.leak_95_method, round(max_leak, 6) AS max_leak,
  round(m.max_leak_30m, 6) AS max_leak_30m, round(m.max_leak_60m, 6) AS max_leak_60m, round(near.minutes, 6) AS max_leak_minutes,
  round(one.leak, 6) AS max_leak_one_minute, round(one.minutes, 6) AS max_leak_one_minute_minutes,
  round(l.sustained_leak_max, 6) AS sustained_leak_max, round(l.sustained_leak_minutes, 6) AS sustained_leak_minutes
FROM m LEFT JOIN near USING (card_id, range_days) LEFT JOIN one USING (card_id, range_days) LEFT JOIN longest l USING (card_id, range_days)"""),
    whole="range_days",
)
def leak_metrics(spark, sf):
    return metrics_of(spark, sf).select(
        "card_id", "range_days", "leak_mean", "leak_95", "leak_95_method", "max_leak", "max_leak_30m", "max_leak_60m",
        "max_leak_minutes", "max_leak_one_minute", "max_leak_one_minute_minutes", "sustained_leak_max", "sustained_leak_minutes",
    )


@query(
    "pressure_metrics",
    with_views(*M_VIEWS, body="""
SELECT card_id, range_days, round(pressure_mean, 6) AS pressure_mean, round(ipap_mean, 6) AS ipap_mean, round(epap_mean, 6) AS epap_mean,
  round(pressure_95, 6) AS pressure_95, round(ipap_95, 6) AS ipap_95, round(epap_95, 6) AS epap_95, epap_95_method,
  round(vt_mean, 6) AS vt_mean, vt_min, vt_max, round(rr_mean, 6) AS rr_mean, rr_min FROM m"""),
    whole="range_days",
)
def pressure_metrics(spark, sf):
    return metrics_of(spark, sf).select(
        "card_id", "range_days", "pressure_mean", "ipap_mean", "epap_mean", "pressure_95", "ipap_95", "epap_95", "epap_95_method",
        "vt_mean", "vt_min", "vt_max", "rr_mean", "rr_min",
    )


@query(
    "ventilation_metrics",
    with_views(*M_VIEWS, body="""
, b AS (
  SELECT r.card_id, v.range_days, round(r.vt_avg, 3) AS bin, count(*) AS n, sum(r.vt_samples) AS seconds
  FROM ranged r JOIN vals v ON v.card_id = r.card_id AND v.clinical_day = r.clinical_day JOIN sized s ON s.card_id = v.card_id AND s.range_days = v.range_days
  WHERE r.vt_avg IS NOT NULL GROUP BY ALL),
q AS (SELECT r.card_id, v.range_days, quantile_cont(round(r.rr_avg, 3), 0.95) AS rr_95
  FROM ranged r JOIN vals v ON v.card_id = r.card_id AND v.clinical_day = r.clinical_day JOIN sized s ON s.card_id = v.card_id AND s.range_days = v.range_days
  WHERE r.rr_avg IS NOT NULL GROUP BY r.card_id, v.range_days),
x AS (SELECT card_id, range_days, quantile_cont(bin, 0.5) AS vt_median FROM (SELECT card_id, range_days, bin, unnest(range(n)) FROM b) GROUP BY card_id, range_days),
z AS (SELECT b.card_id, b.range_days, sum(seconds) FILTER (bin = round(m.vt_min, 3)) AS lo, sum(seconds) FILTER (bin = round(m.vt_max, 3)) AS hi
  FROM b JOIN m USING (card_id, range_days) GROUP BY b.card_id, b.range_days)
SELECT card_id, range_days, round(vt_median, 6) AS vt_median, round(CASE WHEN lo > 0 THEN lo / 60 END, 6) AS vt_min_minutes,
  round(CASE WHEN hi > 0 THEN hi / 60 END, 6) AS vt_max_minutes, round(rr_95, 6) AS rr_95
FROM x FULL JOIN z USING (card_id, range_days) FULL JOIN q USING (card_id, range_days)"""),
    whole="range_days",
)
def ventilation_metrics(spark, sf):
    days = report_days(spark, sf)
    metrics = report.report_metrics(days, RANGES)
    out = histograms_of(spark, sf, report.selected_days(days, RANGES), metrics)
    return out.select("card_id", "range_days", "vt_median", "vt_min_minutes", "vt_max_minutes", "rr_95")


def histograms_of(spark, sf, selected, metrics):
    """Volume and breath-rate histograms of the selected days of each reported window."""
    chosen = selected.join(metrics.select(*periods.WINDOW), list(periods.WINDOW))
    records = a.records(spark, sf).withColumn("clinical_day", clinical_day("date"))
    vt, rr = ranged("vt_avg", TIDAL_VOLUME), ranged("rr_avg", RESPIRATORY_RATE)

    def bins(channel, value, seconds):
        own = records.withColumn("value", value).where("value IS NOT NULL").withColumn("channel", F.lit(channel))
        return rollup.histogram(own, ["card_id", "clinical_day", "channel"], "value", seconds)

    both = bins("vt", vt, "vt_samples").unionByName(bins("rr", rr, "rr_samples"))
    return report.histogram_metrics(both, chosen, metrics)


# The report of both settings periods: in the SQL a key holds card and period, 2 * card_id for the current period and one
# more for the previous one, and in the classification a thousand times that and the range.
NOW = "2024-02-03"
RANGE_ROWS = ", ".join(f"({n})" for n in RANGES)
REPORT_DAYS = f"""
kdays AS (
  SELECT * REPLACE (card_id * 2 AS card_id) FROM days
  UNION ALL SELECT d.* REPLACE (d.card_id * 2 + 1 AS card_id) FROM days d JOIN periods p ON p.card_id = d.card_id AND p.kind = 'previous'
  WHERE d.clinical_day <= p.period_end),
found AS (
  SELECT card_id, range_days, max(clinical_day) AS latest_day, min(clinical_day) AS first_day,
    card_id % 2 = 0 AND count(*) FILTER (clinical_day >= DATE '{NOW}' - CAST(range_days AS INTEGER) AND clinical_day < DATE '{NOW}') > 0 AS recent
  FROM kdays, (VALUES {RANGE_ROWS}) AS r(range_days) GROUP BY card_id, range_days),
fan AS (
  SELECT card_id, range_days, CASE WHEN recent THEN DATE '{NOW}' ELSE latest_day + 1 END AS window_end,
    CASE WHEN recent THEN DATE '{NOW}' ELSE latest_day + 1 END - CAST(range_days AS INTEGER) AS w0, first_day,
    CASE WHEN NOT recent AND card_id % 2 = 0 THEN latest_day END AS anchored_day FROM found),
in_window AS (""" + windowed(RANGES).split("in_window AS (")[1].replace("FROM days d JOIN", "FROM kdays d JOIN").replace(
    "OR range_days = 7", "OR range_days = 7 OR card_id % 2 = 1"
)
SOURCE_DAYS = """
tsess AS (
  SELECT card_id, date_trunc('second', date) AS start_ts,
    date_trunc('second', date) + to_seconds(CAST(floor(usage_hours * 3600) AS BIGINT)) AS end_ts,
    CASE kind WHEN 'signup' THEN CAST(date - INTERVAL 12 HOUR AS DATE) - 1 WHEN 'purchase' THEN CAST(date - INTERVAL 12 HOUR AS DATE) END AS source_day
  FROM records),
ksess AS (
  SELECT s.* REPLACE (s.card_id * 2 + CASE WHEN p.kind = 'previous' THEN 1 ELSE 0 END AS card_id) FROM tsess s JOIN periods p ON p.card_id = s.card_id
  WHERE end_ts > start_ts AND epoch(end_ts) - epoch(start_ts) <= 86400
    AND CASE WHEN source_day IS NOT NULL THEN source_day BETWEEN period_start AND period_end
      ELSE CAST(start_ts - INTERVAL 12 HOUR AS DATE) BETWEEN period_start AND period_end OR CAST(start_ts AS DATE) BETWEEN period_start AND period_end END)"""
PLACED = f"""
wsess AS (
  SELECT s.card_id * 1000 + m.range_days AS card_id, start_ts, end_ts FROM ksess s JOIN m ON m.card_id = s.card_id
  WHERE coalesce(source_day, CAST(start_ts - INTERVAL 12 HOUR AS DATE)) >= m.effective_start
    AND coalesce(source_day, CAST(start_ts - INTERVAL 12 HOUR AS DATE)) < m.window_end),
{walked("wsess", "wclean").strip()},
placed_sessions AS (
  SELECT w.card_id, 0 AS seq, start_ts, end_ts, p.anchor_minutes, (epoch(end_ts) - epoch(start_ts)) / 60 AS minutes,
    CASE WHEN hour(start_ts) * 60 + minute(start_ts) + second(start_ts) / 60 < p.boundary_minutes
         THEN CAST(start_ts AS DATE) - 1 ELSE CAST(start_ts AS DATE) END AS sleep_day
  FROM wclean w JOIN profiles p ON p.card_id = w.card_id // 1000),
seen AS (""" + CLASSIFY.split("seen AS (")[1]
GATE = """
totals AS (
  SELECT card_id // 1000 AS card_id, card_id % 1000 AS range_days, sum(total_minutes) AS total_minutes, sum(principal_minutes) AS principal_minutes,
    sum(greatest(0, total_minutes - principal_minutes)) AS nap_minutes, count(*) FILTER (principal_minutes >= 240) AS timed_compliant_days,
    count(*) FILTER (total_minutes > 0) AS timed_days FROM sleep_days GROUP BY ALL),
gate AS (
  SELECT m.*, t.* EXCLUDE (card_id, range_days), p.confidence, p.drift, p.anchor_minutes, p.window_end_minutes,
    coalesce(t.total_minutes, 0) / 60 AS session_hours,
    CASE WHEN daily_hours > 0 THEN coalesce(t.total_minutes, 0) / 60 / daily_hours * 100 ELSE 0 END AS raw_coverage,
    t.total_minutes IS NOT NULL AND round(CASE WHEN daily_hours > 0 THEN coalesce(t.total_minutes, 0) / 60 / daily_hours * 100 ELSE 0 END, 9) BETWEEN 70 AND 105 AS timed
  FROM m LEFT JOIN totals t ON t.card_id = m.card_id AND t.range_days = m.range_days LEFT JOIN profiles p ON p.card_id = m.card_id),
timing AS (
  SELECT * REPLACE (card_id // 2 AS card_id), CASE WHEN card_id % 2 = 0 THEN 'current' ELSE 'previous' END AS kind, card_id AS k,
    CASE WHEN timed THEN greatest(daily_hours, session_hours) ELSE daily_hours END AS total_hours,
    CASE WHEN timed THEN principal_minutes / 60 END AS principal_hours, CASE WHEN timed THEN nap_minutes / 60 END AS nap_hours,
    CASE WHEN timed THEN greatest(0, daily_hours - session_hours) END AS unclassified_hours,
    CASE WHEN timed THEN least(days_in_window, timed_compliant_days) ELSE usage_compliant_days END AS compliant_days
  FROM gate)"""
TIMED = (
    RECORDS, DAYS, DAY_SETTINGS, SETTINGS_PERIODS, REPORT_DAYS, METRICS, SOURCE_DAYS, walked("ksess", "sessions"),
    DOMINANT.replace("sized", "lengths"), ANCHOR.replace("scores", "kernel"), DRIFT, PROFILE, PLACED, GATE,
)


def both_periods(spark, sf):
    """Days, windows (to a fixed now or the card's last data, and to the end of the previous period) and metrics, as tables."""
    days = keep(report_days(spark, sf), "days")
    own = keep(periods.settings_periods(days.select("card_id", "clinical_day", "signature", "label")), "periods")
    now = F.lit(f"{NOW} 06:00:00").cast("timestamp")
    current = periods.windows_with_fallback(days, now, F.lit(0), RANGES)
    windows = current.unionByName(periods.previous_windows(own, RANGES), allowMissingColumns=True)
    metrics = report.report_metrics(days, windows.drop("anchored_to_latest", "anchored_day"))
    told = windows.select(*periods.WINDOW, "anchored_day")
    return days, windows, own, keep(metrics.join(told, list(periods.WINDOW)), "metrics")


def timed_metrics(spark, sf, metrics, own_periods):
    """Metrics with timing: every usage hour of a record is a session of that length; some name the day they belong to."""
    records = a.records(spark, sf)
    start, day = F.date_trunc("second", "date"), clinical_day("date")
    sessions = valid_sessions(
        records.select(
            "card_id", start.alias("start_ts"), shift_seconds(start, F.floor(F.col("usage_hours") * 3600)).alias("end_ts"),
            F.when(F.col("kind") == "signup", F.date_sub(day, 1)).when(F.col("kind") == "purchase", day).alias("source_clinical_day"),
        )
    )
    return report.timing_metrics(metrics, sessions, own_periods)


@query(
    "timing_metrics",
    with_views(*TIMED, body="""
SELECT card_id, range_days, kind, timed, round(round(raw_coverage, 9), 6) AS raw_coverage, round(round(total_hours, 9), 6) AS total_hours,
  round(round(principal_hours, 9), 6) AS principal_hours, round(round(nap_hours, 9), 6) AS nap_hours, round(round(unclassified_hours, 9), 6) AS unclassified_hours,
  compliant_days, round(round(compliant_days / days_in_window * 100, 9), 6) AS compliance_percent,
  round(round(principal_hours / nullif(timed_days, 0), 9), 6) AS avg_principal_hours, round(round(nap_hours / nullif(timed_days, 0), 9), 6) AS avg_nap_hours,
  confidence, coalesce(drift, false) AS drift FROM timing"""),
    whole="range_days compliant_days",
)
def timing_metrics(spark, sf):
    """Principal, nap and unclassified hours with the timing gate, of the current and of the previous settings period."""
    _, _, own, metrics = both_periods(spark, sf)
    return timed_metrics(spark, sf, metrics, own).select(
        "card_id", "range_days", "kind", "timed", "raw_coverage", "total_hours", "principal_hours", "nap_hours", "unclassified_hours",
        "compliant_days", "compliance_percent", "avg_principal_hours", "avg_nap_hours", "confidence", F.coalesce("drift", F.lit(False)).alias("drift"),
    )


def machines(spark, sf, own_periods):
    """The newest record as the import's machine, with measured values that must not pass on, and the settings of each period."""
    newest = rollup.latest_by(a.records(spark, sf), ["card_id"], ["date", "seq"], ["settings_label", "kind", "pressure_avg", "vt_avg", "rr_min"])
    imported = newest.select(
        "card_id", F.when(F.col("kind") != "error", F.concat(F.lit("Box "), "kind")).alias("device"), F.concat(F.lit("S"), F.col("card_id")).alias("serial"),
        F.col("settings_label").alias("mode"), F.concat((F.col("card_id") % 9 + 4).cast("string"), F.lit(" cmH2O")).alias("epap"),
        F.col("pressure_avg").alias("pressure_mean"), F.col("vt_avg").alias("vt_mean"), "rr_min", F.lit(1.0).alias("vt_median"),
    )
    settings = own_periods.select(
        "card_id", "kind", F.col("label").alias("mode"), F.when(F.col("card_id") % 2 == 0, F.concat(F.lit("Older "), "label")).alias("device"),
        F.when(F.day("period_start") % 3 > 0, F.concat((F.day("period_start") % 5 + 4).cast("string"), F.lit(" cmH2O"))).alias("epap"),
    )
    return imported, settings


MACHINES = """
imported AS (
  SELECT card_id, CASE WHEN arg_max(kind, (date, seq)) <> 'error' THEN 'Box ' || arg_max(kind, (date, seq)) END AS device,
    arg_max(settings_label, (date, seq)) AS mode FROM records GROUP BY card_id),
period_settings AS (
  SELECT card_id, kind, label AS mode, CASE WHEN card_id % 2 = 0 THEN 'Older ' || label END AS device,
    CASE WHEN day(period_start) % 3 > 0 THEN (day(period_start) % 5 + 4) || ' cmH2O' END AS epap FROM periods)"""


@query(
    "measurement_reset",
    with_views(RECORDS, DAYS, DAY_SETTINGS, SETTINGS_PERIODS, REPORT_DAYS, METRICS, MACHINES, body="""
SELECT m.card_id // 2 AS card_id, m.range_days, CASE WHEN m.card_id % 2 = 0 THEN 'current' ELSE 'previous' END AS kind,
  CASE WHEN m.card_id % 2 = 0 THEN i.device ELSE coalesce(p.device, i.device) END AS device, 'S' || i.card_id AS serial,
  CASE WHEN m.card_id % 2 = 0 THEN i.mode ELSE p.mode END AS mode,
  CASE WHEN m.card_id % 2 = 0 THEN (i.card_id % 9 + 4) || ' cmH2O' ELSE p.epap END AS epap,
  round(round(m.pressure_mean, 9), 6) AS pressure_mean, round(round(m.vt_mean, 9), 6) AS vt_mean, m.rr_min, NULL::DOUBLE AS vt_median
FROM m JOIN imported i ON i.card_id = m.card_id // 2
LEFT JOIN period_settings p ON p.card_id = m.card_id // 2 AND p.kind = CASE WHEN m.card_id % 2 = 0 THEN 'current' ELSE 'previous' END"""),
    whole="range_days",
)
def measurement_reset(spark, sf):
    """Settings by period, identity by card, measured values by window: the import's newest measurements never pass on."""
    _, _, own, metrics = both_periods(spark, sf)
    imported, settings = machines(spark, sf, own)
    steady = {c: F.round(c, 9) for c in ("pressure_mean", "vt_mean")}
    measured = metrics.select("card_id", "range_days", "kind", "pressure_mean", "vt_mean", "rr_min").withColumns(steady)
    return periods.report_machine(measured, imported, settings)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(form: str, *values: str) -> str:
    """SQL text of a warning with its braces filled."""
    parts = form.split("{}")
    return " || ".join([_quoted(parts[0]), *(f"{v} || {_quoted(p)}" for v, p in zip(values, parts[1:], strict=True))])


def _when(test: str, text: str) -> str:
    return f"CASE WHEN {test} THEN {text} END"


DAY_TEXT = "strftime({}, '%B %-d, %Y')"
WINDOW_WARNINGS = {
    "anchored": _when("anchored_day IS NOT NULL", _filled(report.W_ANCHORED, DAY_TEXT.format("anchored_day"))),
    "guarded": _when("guard_text IS NOT NULL", "guard_text"),
    "review": _when("kind = 'previous'", _quoted(report.W_REVIEW)),
    "short_history": _when("days_in_window < t.range_days", _filled(
        "Only {} days of therapy history are available; calculations were adjusted from {} days to avoid false deficits.", "days_in_window", "t.range_days")),
    "principal": _when("timed", _quoted(report.W_PRINCIPAL)),
    "drift": _when("timed AND drift", _quoted(report.W_DRIFT)),
    "low_confidence": _when("timed AND NOT drift AND confidence = 'low'", _quoted(report.W_LOW)),
    "over_reported": _when("NOT timed AND daily_hours > 0 AND round(raw_coverage, 9) > 105", _filled(
        "Session intervals exceeded device-reported therapy by {}%; sleep timing was not inferred from inconsistent source data.",
        "CAST(floor(round(raw_coverage - 100, 9) + 0.5) AS BIGINT)")),
    "no_timing": _when("NOT timed AND daily_hours > 0", _quoted(report.W_NO_TIMING)),
    "no_usage": _when("days_with_usage = 0", _quoted(report.W_NO_USAGE)),
    "no_ahi": _when("ahi_mean IS NULL", _quoted(report.W_NO_AHI)),
    "no_leak": _when("coalesce(leak_mean, leak_95, max_leak, max_leak_30m, max_leak_60m) IS NULL", _quoted(report.W_NO_LEAK)),
    "no_device": _when("t.card_id % 3 = 0", _quoted(report.W_NO_DEVICE)),
}
CONTEXT = f"""
shown_layouts AS (
  SELECT card_id, any_value(n) AS n, string_agg(label || ': ' || coalesce(strftime(latest_date, '%Y-%m-%d'), 'no dated folder evidence'), '; ' ORDER BY rn) FILTER (rn <= 4)
    AS txt, bool_and(family_id IN ('sleepstyle', 'icon')) AS alike FROM newest GROUP BY card_id),
best_scores AS (SELECT card_id, string_agg(label || ' (' || score || ')', ', ' ORDER BY rank) AS txt FROM ranked WHERE rank <= 4 GROUP BY card_id),
last_days AS (SELECT card_id, max(clinical_day) AS day FROM days GROUP BY card_id),
context AS (
  SELECT l.card_id, {report.RANKS["mixed_layouts"]} AS rank, CASE WHEN by_date THEN 'Mixed device data detected. Selected ' || r.label
    || ' because it has the newest dated folder data (' || coalesce(strftime(r.latest_date, '%Y-%m-%d'), 'no dated folder evidence') || '). Detected layouts: ' || txt
    || CASE WHEN n > 4 THEN '; ... ' || (n - 4) || ' more' ELSE '' END || '.'
    ELSE 'Multiple device layouts detected. Selected ' || r.label || '. Dated folder comparison: ' || txt || CASE WHEN n > 4 THEN '; ... ' || (n - 4) || ' more' ELSE '' END || '.' END AS text
  FROM shown_layouts l JOIN selected s ON s.card_id = l.card_id LEFT JOIN recency r ON r.card_id = l.card_id AND r.family_id = s.family_id WHERE n >= 2 AND NOT alike
  UNION ALL SELECT s.card_id, {report.RANKS["loader"]}, 'Selected loader: ' || f.label || '. Candidate scores: ' || b.txt || '.'
  FROM selected s JOIN ranked f ON f.card_id = s.card_id AND f.family_id = s.family_id JOIN best_scores b ON b.card_id = s.card_id
  UNION ALL SELECT card_id, {report.RANKS["late_settings"]}, {_filled(report.W_LATE_SETTINGS, "CASE WHEN card_id % 2 = 0 THEN 'BMC' ELSE 'Philips' END", "CASE WHEN card_id % 2 = 0 THEN 'day' ELSE 'session' END")}
  FROM last_days WHERE card_id % 4 > 1
  UNION ALL SELECT card_id, {report.RANKS["duplicates"]}, {_filled(report.W_DUPLICATES, "sum(copies - 1)::BIGINT")} FROM distinct_records GROUP BY card_id HAVING sum(copies - 1) > 0
  UNION ALL SELECT card_id, {report.RANKS["settings_changed"]}, 'Therapy settings changed during the imported 91-day history. Reports use the latest settings period: '
    || arg_max(label, run) || ' since ' || {DAY_TEXT.format("arg_max(start_day, run)")} || '.' FROM runs GROUP BY card_id HAVING count(DISTINCT signature) > 1),
window_signed AS (
  SELECT *, row_number() OVER (PARTITION BY card_id, range_days ORDER BY clinical_day)
    - row_number() OVER (PARTITION BY card_id, range_days, signature ORDER BY clinical_day) AS g FROM in_window),
window_runs AS (
  SELECT card_id, range_days, min(clinical_day) AS a, max(clinical_day) AS b, any_value(label) AS label, any_value(signature) AS signature
  FROM window_signed GROUP BY card_id, range_days, signature, g),
numbered_runs AS (
  SELECT *, row_number() OVER (PARTITION BY card_id, range_days ORDER BY a) AS run, count(*) OVER (PARTITION BY card_id, range_days) AS n,
    label || CASE WHEN a = b THEN ' on ' || {DAY_TEXT.format("a")} ELSE ' from ' || {DAY_TEXT.format("a")} || ' to ' || {DAY_TEXT.format("b")} END AS txt FROM window_runs),
guard AS (
  SELECT card_id AS k, range_days, {_filled(report.W_GUARD, "range_days",
    "CASE WHEN any_value(n) > 4 THEN '... ' || (any_value(n) - 4) || ' earlier setting period(s); ' ELSE '' END || string_agg(txt, '; ' ORDER BY run) FILTER (run > n - 4)",
    "arg_max(label, run)", DAY_TEXT.format("arg_max(a, run)"))} AS guard_text
  FROM numbered_runs GROUP BY card_id, range_days HAVING count(DISTINCT signature) > 1),
said AS (
  SELECT t.card_id, t.range_days, t.kind, unnest([{", ".join("{'rank': %d, 'text': %s}" % (report.RANKS[c], x) for c, x in WINDOW_WARNINGS.items())}]) AS w
  FROM timing t JOIN fan f ON f.card_id = t.k AND f.range_days = t.range_days LEFT JOIN guard g ON g.k = t.k AND g.range_days = t.range_days),
every AS (
  SELECT card_id, range_days, kind, w.rank AS rank, w.text AS text FROM said WHERE w.text IS NOT NULL
  UNION ALL SELECT t.card_id, t.range_days, t.kind, c.rank, c.text FROM timing t JOIN context c ON c.card_id = t.card_id
  WHERE t.kind = 'current' OR c.rank <> {report.RANKS["settings_changed"]})"""


@query(
    "report_warnings",
    with_views(*TIMED, *SELECT_VIEWS, DISTINCT_RECORDS, CONTEXT, body=f"""
SELECT t.card_id, t.range_days, t.kind, CASE WHEN t.card_id % 3 > 0 THEN 'Box ' || t.card_id ELSE 'Not detected from input files' END AS device,
  {DAY_TEXT.format("t.effective_start")} AS date_range_start, {DAY_TEXT.format("t.window_end - 1")} AS date_range_end,
  coalesce((SELECT string_agg(e.text, ' | ' ORDER BY e.rank) FROM every e
    WHERE e.card_id = t.card_id AND e.range_days = t.range_days AND e.kind = t.kind), '') AS warnings FROM timing t"""),
    whole="range_days",
)
def report_warnings(spark, sf):
    """All warnings of every report: the import's context, the window's, the timing's and the missing metrics."""
    days, windows, own, metrics = both_periods(spark, sf)
    timed = timed_metrics(spark, sf, metrics, own).join(
        report.guard_warning(days, windows.drop("anchored_to_latest", "anchored_day")), list(periods.WINDOW), "left"
    )
    files = catalogue_files(spark, sf)
    ranked, chosen = catalogue.ranked_families(files), keep(catalogue.select_family(files), "families")
    last = days.groupBy("card_id").agg(F.max("clinical_day").alias("last"))
    after = periods.settings_after_therapy(F.date_add("last", (F.col("card_id") % 4).cast("int")), F.col("last"))
    bmc = F.col("card_id") % 2 == 0
    late = report.text_of(report.W_LATE_SETTINGS, F.when(bmc, "BMC").otherwise("Philips"), F.when(bmc, "day").otherwise("session"))
    coarse = coarse_records(spark, sf)
    context = [
        report.card_warning("mixed_layouts", catalogue.mixed_warning(catalogue.family_recency(files, ranked), chosen, 4)),
        report.card_warning("loader", catalogue.loader_warning(ranked, chosen)),
        report.card_warning("late_settings", last.where(after), late),
        report.duplicate_warning(coarse, distinct_records(coarse)),
        report.card_warning("settings_changed", periods.change_warning(days.select("card_id", "clinical_day", "signature", "label"), 91)),
    ]
    device = F.when(F.col("card_id") % 3 > 0, F.concat(F.lit("Box "), F.col("card_id"), F.lit(" (SD card)")))
    told = report.with_warnings(timed, reduce(DataFrame.unionByName, context), device)
    return report.final_projection(told, device).select(
        "card_id", "range_days", "kind", "device", "date_range_start", "date_range_end", F.array_join("warnings", " | ").alias("warnings")
    )


PHILIPS, CONFIGURED = "Philips Respironics System One / DreamStation", "Resvent / Hoffrichter"
LATE_BMC, LATE_PHILIPS = (report.W_LATE_SETTINGS.replace("{}", "%s") % x for x in (("BMC", "day"), ("Philips", "session")))


def told_settings(metrics, own_periods):
    """Metrics with settings made from the period's mode and the card's number, its loader and two warnings."""
    n = lambda of, plus, unit, front="": F.concat(F.lit(front), (F.col("card_id") % of + plus).cast("string"), F.lit(unit))
    c = F.col("card_id")
    bilevel, auto = F.col("mode") == "BiPAP", c % 5 == 0
    ranging = (F.col("mode") == "APAP") | (bilevel & auto)
    return metrics.join(own_periods.select("card_id", "kind", F.col("label").alias("mode")), ["card_id", "kind"]).withColumns(
        {
            "pressure": F.when(F.col("mode") == "CPAP", n(9, 6, " cmH2O", "Fixed ")),
            "pressure_min": F.when(ranging, n(4, 4, " cmH2O")), "pressure_max": F.when(ranging, n(6, 12, " cmH2O")),
            "epap": F.when(bilevel & ~auto, n(5, 5, " cmH2O")), "ipap": F.when(bilevel & ~auto, n(7, 12, " cmH2O")),
            "respiratory_rate": F.when(bilevel, n(6, 9, " bpm")),
            "tidal_volume": F.when(bilevel, F.when(c % 2 == 0, n(300, 2800, " mL")).otherwise(n(3, 2, " L"))),
            "ramp_time": n(45, 1, " minutes"), "ramp_pressure": F.when(c % 4 > 0, F.lit("4 cmH2O")), "pressure_relief": F.when(c % 3 > 0, F.lit("EPR: On")),
            "pressure_auto": F.col("mode") == "APAP", "device": F.when(c % 4 == 1, F.lit("VPAP ST")).otherwise("Box"),
            "loader": F.when(c % 3 == 0, PHILIPS).when(c % 3 == 1, CONFIGURED).otherwise("ResMed"),
            "warnings": F.array_compact(F.array(F.when(c % 4 == 2, LATE_BMC), F.when(c % 4 == 3, LATE_PHILIPS), F.when(c % 10 == 0, rows.BOUNDS_DIFFER))),
        }
    )


SETTINGS_TOLD = """
settings AS (
  SELECT *, CASE mode WHEN 'CPAP' THEN card_id % 9 + 6 WHEN 'APAP' THEN card_id % 4 + 4 END AS pressure_least,
    CASE WHEN bi AND auto THEN CASE WHEN card_id % 10 > 0 THEN card_id % 4 + 4 END WHEN bi THEN card_id % 7 + 12 END AS ipap_least,
    CASE WHEN bi AND auto THEN CASE WHEN card_id % 10 > 0 THEN card_id % 4 + 4 END WHEN bi THEN card_id % 5 + 5 END AS epap_least,
    CASE WHEN mode = 'CPAP' THEN card_id % 9 + 6 WHEN mode = 'APAP' OR (bi AND auto) THEN card_id % 4 + 4 END || '.0 cmH2O' AS low_text,
    CASE WHEN mode = 'CPAP' THEN card_id % 9 + 6 WHEN mode = 'APAP' OR (bi AND auto) THEN card_id % 6 + 12 END || '.0 cmH2O' AS high_text,
    CASE WHEN bi THEN CASE WHEN card_id % 2 = 0 THEN (card_id % 300 + 2800) / 1000 ELSE card_id % 3 + 2 END END AS litres,
    CASE WHEN card_id % 4 = 1 THEN card_id % 6 + 9 END AS backup, card_id % 3 = 0 AS total, card_id % 3 = 1 AS config
  FROM (SELECT card_id, kind, label AS mode, label = 'BiPAP' AS bi, card_id % 5 = 0 AS auto FROM periods))"""
# As in the checks of the single metrics, for both periods.
MORE_METRICS = """
lk_near AS (
  SELECT v.card_id, v.range_days, max(v.max_leak_minutes) AS minutes FROM vals v JOIN m ON m.card_id = v.card_id AND m.range_days = v.range_days
  WHERE abs(v.leak_max - m.max_leak) < 0.001 GROUP BY ALL),
lk_longest AS (SELECT card_id, range_days, sustained_leak_max, sustained_leak_minutes FROM vals WHERE sustained_leak_minutes IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY card_id, range_days ORDER BY sustained_leak_minutes DESC, sustained_leak_max DESC) = 1),
h_days AS (SELECT v.card_id, v.range_days, v.clinical_day FROM vals v JOIN sized s ON s.card_id = v.card_id AND s.range_days = v.range_days),
h_bins AS (
  SELECT d.card_id, d.range_days, round(r.vt_avg, 3) AS bin, count(*) AS n, sum(r.vt_samples) AS seconds
  FROM h_days d JOIN ranged r ON r.card_id = d.card_id // 2 AND r.clinical_day = d.clinical_day WHERE r.vt_avg IS NOT NULL GROUP BY ALL),
h_rates AS (
  SELECT d.card_id, d.range_days, quantile_cont(round(r.rr_avg, 3), 0.95) AS rr_95
  FROM h_days d JOIN ranged r ON r.card_id = d.card_id // 2 AND r.clinical_day = d.clinical_day WHERE r.rr_avg IS NOT NULL GROUP BY ALL),
h_medians AS (SELECT card_id, range_days, quantile_cont(bin, 0.5) AS vt_median FROM (SELECT card_id, range_days, bin, unnest(range(n)) FROM h_bins) GROUP BY ALL),
h_minutes AS (
  SELECT b.card_id, b.range_days, nullif(greatest(coalesce(sum(seconds) FILTER (bin = round(m.vt_min, 3)), 0), 0), 0) / 60 AS vt_min_minutes,
    nullif(greatest(coalesce(sum(seconds) FILTER (bin = round(m.vt_max, 3)), 0), 0), 0) / 60 AS vt_max_minutes
  FROM h_bins b JOIN m ON m.card_id = b.card_id AND m.range_days = b.range_days GROUP BY ALL),
p_methods AS (
  SELECT v.card_id, v.range_days, """ + ", ".join(
    f"CASE WHEN count({p}_95_day) > 0 THEN '95th of daily 95th %s' WHEN count({p}_avg_day) > 0 THEN '95th daily %s summary' ELSE '95th %s' END AS {p}_label" % ((title,) * 3)
    for p, title in (("ipap", "IPAP"), ("epap", "EPAP"), ("pressure", "Pressure"))
) + f""" FROM vals v JOIN sized s ON s.card_id = v.card_id AND s.range_days = v.range_days GROUP BY ALL),
{SETTINGS_TOLD.strip()},
told AS (
  SELECT t.*, s.* EXCLUDE (card_id, kind), n.minutes AS max_leak_minutes, l.sustained_leak_max, l.sustained_leak_minutes, r.rr_95, d.vt_median,
    x.vt_min_minutes, x.vt_max_minutes, p.* EXCLUDE (card_id, range_days)
  FROM timing t JOIN settings s ON s.card_id = t.card_id AND s.kind = t.kind
  LEFT JOIN lk_near n ON n.card_id = t.k AND n.range_days = t.range_days LEFT JOIN lk_longest l ON l.card_id = t.k AND l.range_days = t.range_days
  LEFT JOIN h_rates r ON r.card_id = t.k AND r.range_days = t.range_days LEFT JOIN h_medians d ON d.card_id = t.k AND d.range_days = t.range_days
  LEFT JOIN h_minutes x ON x.card_id = t.k AND x.range_days = t.range_days LEFT JOIN p_methods p ON p.card_id = t.k AND p.range_days = t.range_days)"""


def _one(v: str) -> str:
    return f"printf('%.1f', round(round({v}, 9), 1))"


def _low(v: str, limit: str) -> str:
    return f"coalesce(round(round({v}, 9), 1) < round(round({limit}, 9), 1), false)"


def _share(v: str) -> str:
    return f"{_one(v)} || ' h' || CASE WHEN total_hours > 0 THEN ' (' || {_one(f'{v} / total_hours * 100')} || '%)' ELSE '' END"


def _clock(v: str) -> str:
    m = f"(CAST(floor({v} % 1440 + 0.5) AS BIGINT) % 1440)"
    return (
        f"CASE WHEN ({m} // 60) % 12 = 0 THEN 12 ELSE ({m} // 60) % 12 END || ':' || lpad(CAST({m} % 60 AS VARCHAR), 2, '0') "
        f"|| CASE WHEN {m} // 60 >= 12 THEN ' PM' ELSE ' AM' END"
    )


def _leak(v: str, minutes: str = "NULL") -> str:
    part = f"CASE WHEN {minutes} < 0.1 THEN '<0.1' ELSE {_one(minutes)} END"
    return f"{_one(v)} || ' L/min' || CASE WHEN {minutes} > 0 THEN '; episode ' || {part} || ' min' ELSE '' END"


def _volume(v: str, minutes: str = "NULL") -> str:
    return f"CASE WHEN bi THEN {_one(f'{v} * 1000')} || ' mL' || coalesce('; ' || {_one(minutes)} || ' sampled min total', '') END"


def _row_list() -> list[tuple[str, str, str, str, str]]:
    """Section, label, value, emphasis and tone of every row, as SQL over ``told``."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    days = lambda n: f"CAST({n} AS BIGINT) || ' / ' || days_in_window"
    low_share = "coalesce(compliant_days / days_in_window * 100 < 70, false)"
    out = [("Usage Summary", label if label.startswith("CASE") else text(label), value, emphasis, tone) for label, value, emphasis, tone in (
        ("Date range", f"{DAY_TEXT.format('effective_start')} || ' to ' || {DAY_TEXT.format('window_end - 1')}", "false", "''"),
        ("Days with data", days("days_with_data"), "false", "''"),
        ("Usage days (% of range)", f"{_one('days_with_usage / days_in_window * 100')} || '%'", "false", "''"),
        ("Total time", f"{_one('total_hours')} || ' h'", "false", "''"),
        ("  Total sleep / therapy time", _share("principal_hours"), "false", "''"),
        ("  Total nap time", _share("nap_hours"), "false", "''"),
        ("Therapy time not assigned to sleep", "CASE WHEN timed AND unclassified_hours >= 0.05 THEN CAST(floor(unclassified_hours * 60 + 0.5) AS BIGINT) // 60 || ':' "
         "|| lpad(CAST(CAST(floor(unclassified_hours * 60 + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ' (H:MM)' END", "false", "''"),
        ("Inferred sleep window", f"CASE WHEN timed THEN {_clock('anchor_minutes')} || ' to ' || {_clock('window_end_minutes')} || ' (' "
         "|| upper(confidence[1]) || confidence[2:] || ' confidence)' END", "false", "CASE confidence WHEN 'high' THEN 'success' WHEN 'moderate' THEN 'warning' ELSE 'danger' END"),
        ("CASE WHEN timed THEN 'CMS-correlated days (principal episode >= 4h)' ELSE 'Compliant days (daily total >= 4h)' END", days("compliant_days"), low_share, "''"),
        ("Compliance (% of range)", f"{_one('compliant_days / days_in_window * 100')} || '%'", low_share, "''"),
        ("Avg total therapy per used day", f"{_one('avg_usage_hours')} || ' h'", "coalesce(avg_usage_hours < 4, false)", "''"),
    )]
    for label, value, minutes in (("Min Vt (tidal volume)", "vt_min", "vt_min_minutes"), ("Median Vt (tidal volume)", "vt_median", "NULL"),
                                  ("Avg daily Vt (tidal volume)", "vt_mean", "NULL"), ("Max Vt (tidal volume)", "vt_max", "vt_max_minutes")):
        out.append(("BiPAP Report Information", text(label), _volume(value, minutes), f"bi AND {_low(f'{value} * 1000', 'litres * 1000')}", "''"))
    for label, value in (("Min RR", "rr_min"), ("Avg RR", "rr_mean"), ("95th RR", "rr_95")):
        out.append(("BiPAP Report Information", text(label), f"CASE WHEN bi THEN {_one(value)} || ' bpm' END", f"bi AND ({_low(value, '10.0')} OR {_low(value, 'backup')})", "''"))
    for p, word, shown in (("ipap", "IPAP", "bi"), ("epap", "EPAP", "bi"), ("pressure", "pressure", "NOT bi")):
        for label, value in ((f"{p}_label", f"{p}_95"), (text(f"Avg daily {word} summary"), f"{p}_mean")):
            emphasis = f"{shown} AND coalesce({p}_least > 0, false) AND {_low(value, f'{p}_least * 0.9::DOUBLE')}"
            out.append(("Therapy Pressures", label, f"CASE WHEN {shown} THEN {_one(value)} || ' cmH2O' END", emphasis, "''"))
    measured = "(NOT bi OR auto) AND CASE WHEN bi THEN coalesce(ipap_95, ipap_mean, epap_95, epap_mean) ELSE coalesce(pressure_95, pressure_mean) END IS NOT NULL"
    for label, value in ((("Min EPAP", "Config PMin", "Min Pressure"), "low_text"), (("Max IPAP", "Config PMax", "Max Pressure"), "high_text")):
        named = "CASE WHEN bi AND config THEN %s WHEN bi THEN %s ELSE %s END" % (text(label[1]), text(label[0]), text(label[2]))
        out.append(("Therapy Pressures", named, f"CASE WHEN {measured} THEN {value} END", "false", "''"))
    for label, value, emphasis in (
        ("Avg daily AHI", "ahi_mean", "coalesce(ahi_mean > 5, false)"), ("95th daily AHI", "ahi_95", "coalesce(ahi_95 > 5, false)"), ("Avg daily apnea index", "residual_mean", "false"),
        ("95th daily apnea index", "residual_95", "false"), ("Avg daily central apnea index", "central_mean", "false"), ("95th daily central apnea index", "central_95", "false"),
        ("Avg daily RERA index", "rera_mean", "false"),
    ):
        out.append(("Respiratory Events", text(label), _one(value), emphasis, "''"))
    leak_95 = "CASE leak_95_method WHEN 'mean-daily-95' THEN 'Avg daily 95th ' || w WHEN '95-daily-summary' THEN '95th daily ' || w || ' summary' ELSE '95th ' || w END".replace(
        "w ", "(CASE WHEN total THEN 'total leak' ELSE 'leak' END) "
    )
    for label, value, minutes in (
        ("CASE WHEN total THEN 'Avg daily total leak summary' ELSE 'Avg daily leak summary' END", "leak_mean", "NULL"), (leak_95, "leak_95", "NULL"),
        ("'Peak in Longest Leak Episode'", "sustained_leak_max", "sustained_leak_minutes"), ("CASE WHEN total THEN 'Max Total Leak' ELSE 'Max Leak' END", "max_leak", "max_leak_minutes"),
    ):
        out.append(("Leaks", label, _leak(value, minutes), f"NOT total AND coalesce({value} > 30, false)", "''"))
    missing = (
        "list_filter([CASE WHEN CASE WHEN bi THEN coalesce(ipap_95, ipap_mean, epap_95, epap_mean) ELSE coalesce(pressure_95, pressure_mean) END IS NULL THEN 'measured pressure' END, "
        "CASE WHEN coalesce(ahi_mean, residual_mean, central_mean, rera_mean) IS NULL THEN 'respiratory event' END, "
        "CASE WHEN coalesce(leak_mean, leak_95, max_leak) IS NULL THEN 'leak' END], lambda x: x IS NOT NULL)"
    )
    named = f"CASE len({missing}) WHEN 1 THEN ({missing})[1] WHEN 2 THEN ({missing})[1] || ' or ' || ({missing})[2] WHEN 3 THEN ({missing})[1] || ', ' || ({missing})[2] || ', or ' || ({missing})[3] END"
    out.append(("Source Data Limits", "'Card data'", f"'No ' || {named} || ' summaries were available in the imported files.'", "false", "''"))
    tests = {LATE_BMC: "card_id % 4 = 2", LATE_PHILIPS: "card_id % 4 = 3", rows.BOUNDS_DIFFER: "card_id % 10 = 0"}
    out += [("Source Data Limits", "'Card data'", f"CASE WHEN {tests.get(x, 'false')} THEN {text(x)} END", "false", "''") for x in rows.LIMIT_WARNINGS]
    ranging = "(mode = 'APAP' OR (bi AND auto))"
    for label, value in (
        ("Device", "CASE WHEN card_id % 4 = 1 THEN 'VPAP ST' ELSE 'Box' END"), ("Mode", "mode"), ("CASE WHEN config THEN 'Config PMin' ELSE 'Min EPAP' END", f"CASE WHEN bi AND {ranging} THEN low_text END"),
        ("CASE WHEN config THEN 'Config PMax' ELSE 'Max IPAP' END", f"CASE WHEN bi AND {ranging} THEN high_text END"),
        ("IPAP", "CASE WHEN bi AND NOT auto THEN (card_id % 7 + 12) || '.0 cmH2O' END"),
        ("EPAP", "CASE WHEN bi AND NOT auto THEN (card_id % 5 + 5) || '.0 cmH2O' END"), ("Respiratory rate (RR)", "CASE WHEN bi THEN (card_id % 6 + 9) || '.0 bpm' END"),
        ("Tidal volume (Vt)", "CASE WHEN bi THEN CASE WHEN card_id % 2 = 0 THEN (card_id % 300 + 2800) || '.0 mL' ELSE (card_id % 3 + 2) || '000.0 mL' END END"),
        ("Min pressure", "CASE WHEN mode = 'APAP' THEN low_text END"), ("Max pressure", "CASE WHEN mode = 'APAP' THEN high_text END"),
        ("Pressure", "CASE WHEN mode = 'CPAP' THEN (card_id % 9 + 6) || '.0 cmH2O' END"), ("Ramp time", "(card_id % 45 + 1) || ' minutes'"),
        ("Ramp pressure", "CASE WHEN card_id % 4 > 0 THEN '4.0 cmH2O' END"), ("Pressure relief", "CASE WHEN card_id % 3 > 0 THEN 'EPR: On' END"),
    ):
        out.append(("Machine Settings", label if label.startswith("CASE") else text(label), value, "false", "''"))
    return out


ALL_ROWS = "row_lists AS (SELECT card_id, range_days, kind, unnest([" + ",\n  ".join(
    f"{{'section': '{section}', 'pos': {n}, 'label': {label}, 'value': {value}, 'emphasize': {emphasis}, 'tone': {tone}}}"
    for n, (section, label, value, emphasis, tone) in enumerate(_row_list(), 1)
) + "]) AS r FROM told),\nreport_lines AS (SELECT card_id, range_days, kind, r.* FROM row_lists WHERE r.value IS NOT NULL)"
REPORT = (*TIMED, MORE_METRICS, ALL_ROWS)


def whole_report(spark, sf):
    days, windows, own, metrics = both_periods(spark, sf)
    timed = timed_metrics(spark, sf, metrics, own)
    chosen = report.selected_days(days, windows.drop("anchored_to_latest", "anchored_day"))
    filled = told_settings(timed.join(histograms_of(spark, sf, chosen, metrics), list(periods.WINDOW), "left"), own)
    return filled, rows.report_rows(filled)


@query("report_rows", with_views(*REPORT, body="SELECT * FROM report_lines"), whole="range_days pos")
def rows_of_report(spark, sf):
    """Every row of every section, for the ranges of both settings periods."""
    return whole_report(spark, sf)[1]


@query(
    "report_event_rows",
    with_views(*REPORT, body="SELECT card_id, range_days, kind, label, value, emphasize FROM report_lines WHERE section IN ('Respiratory Events', 'Leaks')"),
    whole="range_days",
)
def report_event_rows(spark, sf):
    """All labels of the event and leak sections, with the minutes of the leak episodes."""
    found = whole_report(spark, sf)[1].where(F.col("section").isin("Respiratory Events", "Leaks"))
    return found.select("card_id", "range_days", "kind", "label", "value", "emphasize")


@query(
    "threshold_flags",
    with_views(RECORDS, DAYS, DAY_SETTINGS, SETTINGS_PERIODS, REPORT_DAYS, METRICS, SETTINGS_TOLD, body=f"""
SELECT m.card_id // 2 AS card_id, m.range_days, s.kind, coalesce(ahi_mean > 5, false) AS ahi_high, 100.0 * usage_compliant_days / days_in_window < 70 AS compliance_low,
  coalesce(avg_usage_hours < 4, false) AS use_low, coalesce(max_leak > 30, false) AS leak_high,
  {_low("rr_min", "10.0")} OR (backup IS NOT NULL AND bi AND {_low("rr_min", "backup")}) AS rate_low,
  coalesce(pressure_least > 0, false) AND {_low("pressure_mean", "pressure_least * 0.9::DOUBLE")} AS pressure_low,
  coalesce(ipap_least > 0, false) AND {_low("ipap_mean", "ipap_least * 0.9::DOUBLE")} AS ipap_low,
  coalesce(epap_least > 0, false) AND {_low("epap_mean", "epap_least * 0.9::DOUBLE")} AS epap_low, {_low("vt_mean * 1000", "litres * 1000")} AS volume_low
FROM m JOIN settings s ON s.card_id = m.card_id // 2 AND s.kind = CASE WHEN m.card_id % 2 = 0 THEN 'current' ELSE 'previous' END"""),
    whole="range_days",
)
def threshold_flags(spark, sf):
    """Flags of the measured values against fixed limits and against the settings of the period."""
    _, _, own, metrics = both_periods(spark, sf)
    told = told_settings(metrics, own).withColumn("compliance_percent", F.col("usage_compliant_days") / F.col("days_in_window") * 100)
    fixed = {n: c for n, c in rows.flags().items() if n != "rate_low"}
    return told.select(
        "card_id", "range_days", "kind", *[c.alias(n) for n, c in fixed.items()], *[c.alias(n) for n, c in rows.setting_flags(told).items()]
    )


@query(
    "write_reports",
    with_views(*REPORT, body="""
SELECT t.card_id, t.range_days, t.kind, t.days_with_data, round(round(t.total_hours, 9), 6) AS total_hours, l.n_rows, l.n_sections, l.digest
FROM timing t JOIN (SELECT card_id, range_days, kind, count(*) AS n_rows, count(DISTINCT section) AS n_sections, sum(length(value) + pos)::BIGINT AS digest
  FROM report_lines GROUP BY ALL) l ON l.card_id = t.card_id AND l.range_days = t.range_days AND l.kind = t.kind"""),
    whole="range_days days_with_data",
)
def write_reports(spark, sf):
    """The artifact of each range, metrics and rows, written and read back."""
    metrics, lines = whole_report(spark, sf)
    path = f"{checkpoint_dir(spark)}/reports-{uuid.uuid4().hex}"
    sinks.write_reports(metrics.drop("warnings"), f"{path}/metrics")
    sinks.write_reports(lines, f"{path}/rows")
    keys = list(periods.WINDOW)
    counted = spark.read.parquet(f"{path}/rows").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("section").alias("n_sections"), F.sum(F.length("value") + F.col("pos")).alias("digest")
    )
    return spark.read.parquet(f"{path}/metrics").select(*keys, "days_with_data", "total_hours").join(counted, keys)


@query(
    "share_text",
    "SELECT event_id, printf('%.1f', round(round(value * 1.0007 / 20, 9), 1)) || ' h' || CASE WHEN event_id % 5 > 0 THEN ' (' || printf('%.1f', round(round(value * 1.0007 / 20 / (event_id % 5 * 8) * 100, 9), 1)) || '%)' ELSE '' END AS text FROM events",
)
def share_text(spark, sf):
    from noonday.plans.rows import share_text as text

    value = F.col("value") * 1.0007 / 20
    return a.read(spark, sf, "events").select("event_id", text(value, (F.col("event_id") % 5 * 8).cast("double")).alias("text"))
