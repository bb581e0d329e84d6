"""Queries: settings guards, report windows and range fan-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day, staleness
from noonday.operators import periods as p
from noonday.operators import rollup
from noonday.plans import adapters as a
from noonday.plans.adapters import DAY_SETTINGS, RECORDS, with_views
from noonday.plans.q_clean import SETTINGS_PERIODS
from noonday.plans.q_report import MACHINES, machines, report_days
from noonday.plans.registry import query
from noonday.plans.sql_parts import RECORD_DAYS, windowed


@query(
    "lookback_norm",
    """
SELECT event_id, CASE WHEN value >= 150 THEN least(CAST(90 AS BIGINT), 91 + user_id)
  WHEN value >= 1 THEN least(CAST(floor(value) AS BIGINT), 91 + user_id) ELSE 90 END AS days,
  CASE WHEN event_type = 'error' OR value - 50 < 1 THEN 90 ELSE CAST(floor(value - 50) AS BIGINT) END AS plain
FROM events""",
    whole="days plain",
)
def lookback_norm(spark, sf):
    events = a.read(spark, sf, "events")
    value = F.when(F.col("value") >= 150, F.lit(float("inf"))).otherwise(F.col("value"))
    plain = F.when(F.col("event_type") != "error", F.col("value") - 50)
    return events.select(
        "event_id",
        p.lookback_days(value, F.col("user_id") + 91).alias("days"),
        p.lookback_days(plain).alias("plain"),
    )


@query(
    "report_windows",
    with_views(*RECORD_DAYS, body="""
, c AS (SELECT card_id, max(clinical_day) AS latest, CAST(card_id % 29 - 14 AS BIGINT) * 60 AS off FROM days GROUP BY card_id),
w AS (
  SELECT card_id, CAST(TIMESTAMP '2024-02-01 07:30:00' + to_minutes(off) AS DATE) AS now_end, latest + 1 AS latest_end,
    latest + 3 AS label_end FROM c)
SELECT card_id, now_end - 30 AS now_start, now_end, latest_end - 30 AS latest_start, latest_end,
  label_end - 30 AS label_start, label_end FROM w"""),
    days="now_start now_end latest_start latest_end label_start label_end",
)
def report_windows(spark, sf):
    """Windows to now at the card's offset, to the latest day, and to a given end label."""
    cards = rollup.day_parts(a.records(spark, sf)).groupBy("card_id").agg(F.max("clinical_day").alias("latest"))
    now = F.lit("2024-02-01 07:30:00").cast("timestamp")
    n0, n1 = p.window_to_now(now, (F.col("card_id") % 29 - 14) * 60, 30)
    l0, l1 = p.window_to_latest(F.col("latest"), 30)
    e0, e1 = p.window_to_label(F.date_add("latest", 3), 30)
    return cards.select(
        "card_id", n0.alias("now_start"), n1.alias("now_end"), l0.alias("latest_start"), l1.alias("latest_end"),
        e0.alias("label_start"), e1.alias("label_end"),
    )


@query(
    "history_clamp",
    with_views(*RECORD_DAYS, body="""
, c AS (SELECT card_id, min(clinical_day) AS f, max(clinical_day) + 1 AS e FROM days GROUP BY card_id),
h AS (SELECT *, f + CAST(card_id % 50 AS INTEGER) - 10 AS hist, e - 30 AS s FROM c)
SELECT card_id, greatest(s, CASE WHEN hist < e THEN least(f, hist) ELSE f END) AS effective_start,
  date_diff('day', greatest(s, CASE WHEN hist < e THEN least(f, hist) ELSE f END), e) AS span FROM h"""),
    days="effective_start",
)
def history_clamp(spark, sf):
    cards = rollup.day_parts(a.records(spark, sf)).groupBy("card_id").agg(
        F.min("clinical_day").alias("f"), F.date_add(F.max("clinical_day"), 1).alias("e")
    )
    history = F.date_add("f", (F.col("card_id") % 50 - 10).cast("int"))
    start = p.clamp_start(F.date_sub("e", 30), F.col("e"), F.col("f"), history)
    return cards.select(
        "card_id", start.alias("effective_start"), F.datediff("e", start).cast("bigint").alias("span")
    )


@query(
    "empty_fallback",
    with_views(*RECORD_DAYS, body="""
, c AS (
  SELECT card_id, max(clinical_day) AS latest, CAST(TIMESTAMP '2024-02-03 06:00:00' AS DATE) AS e,
    count(*) FILTER (clinical_day >= DATE '2024-02-03' - 5 AND clinical_day < DATE '2024-02-03') AS n
  FROM days GROUP BY card_id)
SELECT card_id, CASE WHEN n > 0 THEN e - 5 ELSE latest + 1 - 5 END AS window_start,
  CASE WHEN n > 0 THEN e ELSE latest + 1 END AS window_end, n = 0 AS anchored_to_latest FROM c"""),
    days="window_start window_end",
)
def empty_fallback(spark, sf):
    days = rollup.day_parts(a.records(spark, sf)).select("card_id", "clinical_day")
    now = F.lit("2024-02-03 06:00:00").cast("timestamp")
    out = p.windows_with_fallback(days, now, F.lit(0), 5)
    return out.select("card_id", "window_start", "window_end", "anchored_to_latest")


@query(
    "settings_guard",
    with_views(*RECORD_DAYS, windowed(), body="""
SELECT card_id, range_days, count(*) AS days, any_value(guarded) AS guarded, min(effective_start) AS effective_start,
  min(clinical_day) AS first_day FROM chosen GROUP BY card_id, range_days"""),
    days="effective_start first_day", whole="range_days",
)
def settings_guard(spark, sf):
    days = report_days(spark, sf).select("card_id", "clinical_day", "signature", "label")
    chosen = p.guard_settings(p.window_days(days, p.fan_out(days)))
    return chosen.groupBy("card_id", "range_days").agg(
        F.count(F.lit(1)).alias("days"), F.bool_or("guarded").alias("guarded"),
        F.min("effective_start").alias("effective_start"), F.min("clinical_day").alias("first_day"),
    )


@query(
    "settings_change_warning",
    with_views(RECORDS, DAY_SETTINGS, SETTINGS_PERIODS, body="""
SELECT card_id, count(DISTINCT signature) AS n_signatures,
  'Therapy settings changed during the imported 91-day history. Reports use the latest settings period: '
  || arg_max(label, run) || ' since ' || strftime(arg_max(start_day, run), '%B %-d, %Y') || '.' AS warning
FROM runs GROUP BY card_id HAVING count(DISTINCT signature) > 1"""),
)
def settings_change_warning(spark, sf):
    return p.change_warning(a.day_settings(spark, sf), 91)


@query(
    "previous_period",
    with_views(RECORDS, DAY_SETTINGS, SETTINGS_PERIODS, MACHINES, body="""
, w AS (SELECT card_id, period_end + 1 AS e, period_end + 1 - 90 AS s, signature AS period_signature FROM periods WHERE kind = 'previous'),
f AS (SELECT card_id, min(clinical_day) AS first_day FROM day_settings GROUP BY card_id),
d AS (SELECT d.*, w.e, greatest(w.s, f.first_day) AS s0 FROM day_settings d JOIN w USING (card_id) JOIN f USING (card_id)
  WHERE d.clinical_day >= w.s AND d.clinical_day < w.e),
o AS (
  SELECT d.card_id, max(d.clinical_day) AS other_day FROM d JOIN w USING (card_id)
  WHERE d.signature <> w.period_signature GROUP BY d.card_id)
SELECT d.card_id, min(CASE WHEN o.other_day IS NULL THEN s0 ELSE clinical_day END) AS effective_start,
  any_value(e) AS window_end, count(*) AS days, any_value(d.label) AS label, any_value(p.mode) AS mode, any_value(p.epap) AS epap,
  any_value(coalesce(p.device, i.device)) AS device, NULL::DOUBLE AS pressure_mean
FROM d LEFT JOIN o USING (card_id) JOIN imported i ON i.card_id = d.card_id JOIN period_settings p ON p.card_id = d.card_id AND p.kind = 'previous'
WHERE o.other_day IS NULL OR clinical_day > other_day GROUP BY d.card_id"""),
    days="effective_start window_end",
)
def previous_period(spark, sf):
    """Window and machine of the earlier settings period: its own settings, the import's device, nothing measured."""
    days = a.day_settings(spark, sf)
    own = p.settings_periods(days)
    chosen = p.guard_settings(p.window_days(days, p.previous_windows(own)))
    windows = chosen.groupBy("card_id", "kind").agg(
        F.min("effective_start").alias("effective_start"), F.max("window_end").alias("window_end"),
        F.count(F.lit(1)).alias("days"), F.min("label").alias("label"),
    )
    return p.report_machine(windows, *machines(spark, sf, own)).select(
        "card_id", "effective_start", "window_end", "days", "label", "mode", "epap", "device", "pressure_mean"
    )


@query(
    "range_fanout",
    with_views(*RECORD_DAYS, body="""
, f AS (
  SELECT card_id, range_days, max(clinical_day) + 1 AS e, max(clinical_day) + 1 - range_days AS s, min(clinical_day) AS first_day
  FROM days, (VALUES (90), (60), (30), (14), (7)) AS r(range_days) GROUP BY card_id, range_days),
z AS (SELECT *, greatest(1, least(range_days, date_diff('day', greatest(s, first_day), e))) AS days_in_window FROM f)
SELECT z.card_id, z.range_days, any_value(days_in_window) AS days_in_window, count(*) AS days_with_data,
  any_value(greatest(s, first_day)) AS shown_start, any_value(e - 1) AS shown_end, any_value(days_in_window) < z.range_days AS shortened
FROM z JOIN days d ON z.card_id = d.card_id AND d.clinical_day >= greatest(s, first_day) AND d.clinical_day < e
WHERE days_in_window >= z.range_days OR z.range_days = 7 GROUP BY z.card_id, z.range_days"""),
    days="shown_start shown_end", whole="range_days days_in_window",
)
def range_fanout(spark, sf):
    days = rollup.day_parts(a.records(spark, sf)).select("card_id", "clinical_day")
    rows = p.window_days(days, p.fan_out(days, (90, 60, 30, 14, 7)))
    sized = rows.withColumn(
        "days_in_window", p.effective_days(F.col("effective_start"), F.col("window_end"), F.col("range_days"))
    ).where(p.enough_days(F.col("range_days"), F.col("days_in_window")))
    return sized.groupBy("card_id", "range_days").agg(
        F.max("days_in_window").alias("days_in_window"), F.count(F.lit(1)).alias("days_with_data"),
        F.min("effective_start").alias("shown_start"), F.date_sub(F.max("window_end"), 1).alias("shown_end"),
    ).withColumn("shortened", F.col("days_in_window") < F.col("range_days"))


@query(
    "latest_day",
    """
SELECT o_custkey AS card_id, CAST(greatest(max(o_orderdate), coalesce(max(l_shipdate), max(o_orderdate))) AS DATE) AS latest_day
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""",
    days="latest_day",
)
def latest_day(spark, sf):
    orders = a.read(spark, sf, "orders")
    records = orders.select(F.col("o_custkey").alias("card_id"), F.to_date("o_orderdate").alias("clinical_day"))
    ships = a.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("record_date"))
    paths = ships.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("card_id"), "record_date"
    )
    return p.latest_days(records, paths)


@query(
    "settings_after_therapy",
    with_views(*RECORD_DAYS, body="""
SELECT card_id, max(clinical_day) AS last_therapy, max(clinical_day) + CAST(card_id % 4 AS INTEGER) AS latest_settings,
  card_id % 4 > 1 AS after_therapy FROM days GROUP BY card_id"""),
    days="last_therapy latest_settings",
)
def settings_after_therapy(spark, sf):
    cards = rollup.day_parts(a.records(spark, sf)).groupBy("card_id").agg(F.max("clinical_day").alias("last_therapy"))
    with_settings = cards.withColumn("latest_settings", F.date_add("last_therapy", (F.col("card_id") % 4).cast("int")))
    return with_settings.withColumn(
        "after_therapy", p.settings_after_therapy(F.col("latest_settings"), F.col("last_therapy"))
    )


@query(
    "settings_conflict",
    """
WITH s AS (SELECT o_custkey AS card_id, arg_max(o_orderpriority, o_orderkey) AS summary_mode FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
r AS (SELECT o_custkey AS card_id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS record_mode FROM orders GROUP BY o_custkey)
SELECT r.card_id, coalesce(record_mode, summary_mode) AS mode, coalesce(summary_mode <> record_mode, false) AS conflict
FROM r LEFT JOIN s USING (card_id)""",
)
def settings_conflict(spark, sf):
    rows = a.read(spark, sf, "orders").withColumn("card_id", F.col("o_custkey"))
    summary = rollup.latest_by(
        rows.where("o_orderstatus = 'F'"), ["card_id"], ["o_orderkey"], ["o_orderpriority"]
    ).withColumnRenamed("o_orderpriority", "summary_mode")
    record = rollup.latest_by(rows, ["card_id"], ["o_orderdate", "o_orderkey"], ["o_orderpriority"])
    joined = record.withColumnRenamed("o_orderpriority", "record_mode").join(summary, "card_id", "left")
    mode, conflict = p.settings_conflict(F.col("summary_mode"), F.col("record_mode"))
    return joined.select("card_id", mode.alias("mode"), conflict.alias("conflict"))


@query(
    "summary_or_session",
    """
SELECT o_custkey AS card_id, o_orderkey AS seq,
  CASE WHEN bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') OVER (PARTITION BY o_custkey)
    AND NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') THEN 'timing' ELSE 'record' END AS use
FROM orders""",
)
def summary_or_session(spark, sf):
    rows = a.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("card_id"), F.col("o_orderkey").alias("seq"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("is_summary"),
    )
    return p.summary_or_session(rows).select("card_id", "seq", "use")


@query(
    "recent_runs_text",
    with_views(RECORDS, DAY_SETTINGS, SETTINGS_PERIODS, body="""
, t AS (
  SELECT card_id, run, count(*) OVER (PARTITION BY card_id) AS n, label || CASE WHEN start_day = end_day
    THEN ' on ' || strftime(start_day, '%B %-d, %Y')
    ELSE ' from ' || strftime(start_day, '%B %-d, %Y') || ' to ' || strftime(end_day, '%B %-d, %Y') END AS txt FROM runs)
SELECT card_id, any_value(n) AS n_runs, CASE WHEN any_value(n) > 2 THEN '... ' || (any_value(n) - 2) || ' earlier setting period(s); ' ELSE '' END
  || string_agg(txt, '; ' ORDER BY run) FILTER (run > n - 2) AS text
FROM t GROUP BY card_id"""),
)
def recent_runs_text(spark, sf):
    return p.runs_text(p.settings_runs(a.day_settings(spark, sf)), visible=2)


@query(
    "staleness",
    with_views(*RECORD_DAYS, body="""
, c AS (SELECT card_id, date_diff('day', max(clinical_day), DATE '2024-02-01') + card_id % 100 AS age FROM days GROUP BY card_id)
SELECT card_id, age, CASE WHEN age > 90 THEN 'critical' WHEN age > 30 THEN 'warning' WHEN age > 7 THEN 'notice' END AS state FROM c"""),
)
def stale(spark, sf):
    cards = a.records(spark, sf).groupBy("card_id").agg(F.max(clinical_day("date")).alias("latest"))
    age = F.datediff(F.lit("2024-02-01"), "latest") + F.col("card_id") % 100
    return cards.select("card_id", age.alias("age"), staleness(age).alias("state"))


@query(
    "clinical_day",
    """
SELECT event_id, CAST(ts - INTERVAL 12 HOUR AS DATE) AS day,
  date_trunc('day', ts + to_minutes((user_id % 29 - 14) * 60)) + INTERVAL 12 HOUR AS noon FROM events""",
    days="day", times="noon",
)
def clinical_days(spark, sf):
    from noonday.functions.dates import local_noon

    return a.read(spark, sf, "events").select(
        "event_id", clinical_day("ts").alias("day"), local_noon("ts", (F.col("user_id") % 29 - 14) * 60).alias("noon")
    )
