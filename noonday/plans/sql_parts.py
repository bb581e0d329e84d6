"""SQL text shared by the checking queries (DuckDB dialect)."""

from __future__ import annotations

from noonday.plans.adapters import RECORDS

_RANGES = {
    "usage": "{c} >= 0 AND {c} <= 24",
    "rate": "{c} >= 0 AND {c} < 200",
    "leak": "{c} >= 0 AND {c} < 500",
    "minutes": "{c} >= 0",
    "pressure": "{c} > 0 AND {c} <= 80",
    "rr": "{c} > 0 AND {c} <= 120",
    "vt": "{c} > 0 AND {c} <= 5",
}
FIELD_KIND = {
    "usage_hours": "usage", "ahi": "rate", "residual_apneas": "rate", "central_apneas": "rate", "rera_index": "rate",
    "leak": "leak", "leak_95": "leak", "leak_max": "leak", "leak_max_30m": "leak", "leak_max_60m": "leak",
    "max_leak_minutes": "minutes", "sustained_leak_max": "leak", "sustained_leak_minutes": "minutes",
    "pressure_avg": "pressure", "pressure_95": "pressure", "ipap_avg": "pressure", "ipap_95": "pressure",
    "epap_avg": "pressure", "epap_95": "pressure", "vt_avg": "vt", "vt_min": "vt", "vt_max": "vt",
    "rr_avg": "rr", "rr_min": "rr", "max_leak_duration_value": "leak",
}


def test(field: str) -> str:
    return "(" + _RANGES[FIELD_KIND[field]].format(c=field) + ")"


def ranged(field: str) -> str:
    return f"CASE WHEN {test(field)} THEN {field} END"


_SUM_FIELDS = [
    "usage_hours", "residual_apneas", "central_apneas", "rera_index", "leak", "leak_95",
    "pressure_avg", "pressure_95", "ipap_avg", "ipap_95", "epap_avg", "epap_95",
]

DAYS = f"""
ranged AS (
  SELECT card_id, seq, CAST(date - INTERVAL 12 HOUR AS DATE) AS clinical_day,
    {", ".join(f"{ranged(f)} AS {f}" for f in FIELD_KIND)},
    CASE WHEN vt_samples > 0 THEN vt_samples ELSE 1 END AS vt_w,
    CASE WHEN rr_samples > 0 THEN rr_samples ELSE 1 END AS rr_w,
    vt_samples, settings_signature AS signature, settings_label AS label
  FROM records),
day_sums AS (
  SELECT card_id, clinical_day,
    {", ".join(f"sum({f}) AS {f}_sum, count({f}) AS {f}_n" for f in _SUM_FIELDS)},
    sum(CASE WHEN usage_hours > 0 THEN ahi * usage_hours END) AS ahi_weighted_sum,
    sum(CASE WHEN usage_hours > 0 AND ahi IS NOT NULL THEN usage_hours END) AS ahi_weight_hours,
    sum(CASE WHEN NOT coalesce(usage_hours > 0, false) THEN ahi END) AS ahi_sum,
    count(CASE WHEN NOT coalesce(usage_hours > 0, false) THEN ahi END) AS ahi_n,
    sum(vt_avg * vt_w) AS vt_sum, sum(CASE WHEN vt_avg IS NOT NULL THEN vt_w END) AS vt_n,
    sum(rr_avg * rr_w) AS rr_sum, sum(CASE WHEN rr_avg IS NOT NULL THEN rr_w END) AS rr_n,
    min(vt_min) AS vt_min, max(vt_max) AS vt_max, min(rr_min) AS rr_min,
    max(leak_max_30m) AS leak_max_30m, max(leak_max_60m) AS leak_max_60m,
    count(*) AS n_records, any_value(signature) AS signature, any_value(label) AS label
  FROM ranged GROUP BY ALL),
top_pair AS (
  SELECT card_id, clinical_day, leak_max, max_leak_minutes AS top_minutes
  FROM (SELECT *, row_number() OVER (PARTITION BY card_id, clinical_day
                                     ORDER BY leak_max DESC, coalesce(max_leak_minutes, -1) DESC) AS rn
        FROM ranged WHERE leak_max IS NOT NULL) WHERE rn = 1),
run_pair AS (
  SELECT card_id, clinical_day, sustained_leak_max, sustained_leak_minutes
  FROM (SELECT *, row_number() OVER (PARTITION BY card_id, clinical_day
                                     ORDER BY sustained_leak_minutes DESC, sustained_leak_max DESC) AS rn
        FROM ranged WHERE sustained_leak_max IS NOT NULL AND sustained_leak_minutes IS NOT NULL) WHERE rn = 1),
near_pair AS (
  SELECT r.card_id, r.clinical_day, max(r.max_leak_minutes) AS matched_minutes
  FROM ranged r JOIN top_pair t USING (card_id, clinical_day)
  WHERE abs(r.max_leak_duration_value - t.leak_max) < 0.001 AND r.max_leak_minutes IS NOT NULL
  GROUP BY ALL),
days AS (
  SELECT s.*, t.leak_max,
    CASE WHEN t.top_minutes IS NULL THEN n.matched_minutes WHEN n.matched_minutes IS NULL THEN t.top_minutes
         ELSE greatest(t.top_minutes, n.matched_minutes) END AS max_leak_minutes,
    p.sustained_leak_max, p.sustained_leak_minutes
  FROM day_sums s
  LEFT JOIN top_pair t USING (card_id, clinical_day)
  LEFT JOIN run_pair p USING (card_id, clinical_day)
  LEFT JOIN near_pair n USING (card_id, clinical_day))
"""

RECORD_DAYS = [RECORDS, DAYS]


def sql_ranges(days: tuple[int, ...]) -> str:
    return "(VALUES " + ", ".join(f"({d})" for d in days) + ") AS r(range_days)"


def windowed(ranges: tuple[int, ...] = (90, 60, 30, 7)) -> str:
    """Day rows of every report window after the history clamp and the settings guard."""
    return f"""
fan AS (
  SELECT card_id, range_days, max(clinical_day) + 1 AS window_end, max(clinical_day) + 1 - range_days AS w0,
         min(clinical_day) AS first_day
  FROM days, {sql_ranges(ranges)} GROUP BY card_id, range_days),
in_window AS (
  SELECT d.*, f.range_days, f.window_end, greatest(f.w0, f.first_day) AS clamped
  FROM days d JOIN fan f USING (card_id)
  WHERE d.clinical_day >= greatest(f.w0, f.first_day) AND d.clinical_day < f.window_end),
last_sig AS (
  SELECT card_id, range_days, arg_max(signature, clinical_day) AS last_signature FROM in_window GROUP BY ALL),
last_other AS (
  SELECT w.card_id, w.range_days, max(w.clinical_day) AS other_day
  FROM in_window w JOIN last_sig l USING (card_id, range_days)
  WHERE w.signature <> l.last_signature GROUP BY ALL),
chosen AS (
  SELECT w.*, o.other_day IS NOT NULL AS guarded,
    CASE WHEN o.other_day IS NULL THEN w.clamped
         ELSE min(CASE WHEN w.clinical_day > o.other_day THEN w.clinical_day END)
              OVER (PARTITION BY w.card_id, w.range_days) END AS effective_start
  FROM in_window w LEFT JOIN last_other o USING (card_id, range_days)
  QUALIFY o.other_day IS NULL OR w.clinical_day > o.other_day),
vals AS (
  SELECT *,
    CASE WHEN usage_hours_n > 0 THEN least(24.0, usage_hours_sum) END AS usage_day,
    CASE WHEN ahi_weight_hours > 0 THEN ahi_weighted_sum / ahi_weight_hours
         WHEN ahi_n > 0 THEN ahi_sum / ahi_n END AS ahi_day,
    residual_apneas_sum / nullif(residual_apneas_n, 0) AS residual_day,
    central_apneas_sum / nullif(central_apneas_n, 0) AS central_day,
    rera_index_sum / nullif(rera_index_n, 0) AS rera_day,
    leak_sum / nullif(leak_n, 0) AS leak_day,
    leak_95_sum / nullif(leak_95_n, 0) AS leak_95_day,
    pressure_avg_sum / nullif(pressure_avg_n, 0) AS pressure_avg_day,
    pressure_95_sum / nullif(pressure_95_n, 0) AS pressure_95_day,
    ipap_avg_sum / nullif(ipap_avg_n, 0) AS ipap_avg_day,
    ipap_95_sum / nullif(ipap_95_n, 0) AS ipap_95_day,
    epap_avg_sum / nullif(epap_avg_n, 0) AS epap_avg_day,
    epap_95_sum / nullif(epap_95_n, 0) AS epap_95_day,
    vt_sum / nullif(vt_n, 0) AS vt_day,
    rr_sum / nullif(rr_n, 0) AS rr_day
  FROM chosen),
sized AS (
  SELECT card_id, range_days,
    greatest(1, least(range_days, date_diff('day', min(effective_start), any_value(window_end)))) AS days_in_window
  FROM vals GROUP BY card_id, range_days
  HAVING greatest(1, least(range_days, date_diff('day', min(effective_start), any_value(window_end)))) >= range_days
         OR range_days = 7)
"""
