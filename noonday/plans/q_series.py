"""Queries: islands, rolling averages, episodes, mask sessions, marker pairs, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day
from noonday.operators import periods, series, sleep
from noonday.plans import adapters as a
from noonday.plans.adapters import DAY_SETTINGS, RECORDS, SAMPLES, SESSIONS, with_views
from noonday.plans.q_clean import SETTINGS_PERIODS
from noonday.plans.registry import query

_ORDER = ["ts", "seq"]
_GAP = 24 * 3600.0


@query(
    "rolling_max_avg",
    with_views(SAMPLES, body="""
, placed AS (
  SELECT *, row_number() OVER w AS rn,
    avg(value) OVER (w ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS r30,
    avg(value) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS r60
  FROM samples WINDOW w AS (PARTITION BY card_id ORDER BY ts, seq))
SELECT card_id, round(max(CASE WHEN rn >= 15 THEN r30 END), 6) AS max_30m,
  round(max(CASE WHEN rn >= 30 THEN r60 END), 6) AS max_60m FROM placed GROUP BY card_id"""),
)
def rolling_max_avg(spark, sf):
    islands = series.reset_islands(a.samples(spark, sf), ["card_id"], _ORDER, F.lit(True), None)
    return series.rolling_maxima(islands, ["card_id"], ["card_id"], "value", {"max_30m": 15, "max_60m": 30})


@query(
    "rolling_max_long",
    with_views(SAMPLES, body="""
, placed AS (
  SELECT *, row_number() OVER w AS rn,
    avg(value) OVER (w ROWS BETWEEN 1799 PRECEDING AND CURRENT ROW) AS r30,
    avg(value) OVER (w ROWS BETWEEN 3599 PRECEDING AND CURRENT ROW) AS r60
  FROM samples WINDOW w AS (PARTITION BY event_type ORDER BY ts, seq))
SELECT event_type, round(max(CASE WHEN rn >= 1800 THEN r30 END), 6) AS max_30m,
  round(max(CASE WHEN rn >= 3600 THEN r60 END), 6) AS max_60m FROM placed GROUP BY event_type HAVING max(rn) >= 1800"""),
)
def rolling_max_long(spark, sf):
    """The windows of 30 and 60 minutes at one sample a second, on a few tracks that hold the whole table."""
    islands = series.reset_islands(a.samples(spark, sf), ["event_type"], _ORDER, F.lit(True), None)
    return series.rolling_maxima(islands, ["event_type"], ["event_type"], "value", {"max_30m": 1_800, "max_60m": 3_600})


@query(
    "reset_islands",
    with_views(SAMPLES, body="""
, placed AS (
  SELECT *, event_type <> 'error' AS ok, lag(event_type <> 'error') OVER w AS prev_ok, lag(ts) OVER w AS prev_ts,
    row_number() OVER w AS rn
  FROM samples WINDOW w AS (PARTITION BY card_id ORDER BY ts, seq)),
marked AS (
  SELECT *, max(CASE WHEN NOT coalesce(prev_ok, false) OR epoch_us(ts) - epoch_us(prev_ts) > 86400 * 1000000::BIGINT
                THEN rn END) OVER (PARTITION BY card_id ORDER BY rn) AS island
  FROM placed),
best AS (
  SELECT *, rn - island + 1 AS pos FROM marked WHERE ok)
SELECT card_id, island, count(*) AS n, max(pos) AS last_pos, min(ts) AS start_ts, round(avg(value), 6) AS mean_value
FROM best GROUP BY card_id, island"""),
    times="start_ts",
)
def reset_islands(spark, sf):
    islands = series.reset_islands(a.samples(spark, sf), ["card_id"], _ORDER, F.col("event_type") != "error", _GAP)
    return islands.groupBy("card_id", "island").agg(
        F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"), F.min("ts").alias("start_ts"),
        F.avg("value").alias("mean_value"),
    )


RUNS = """
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY ts, seq) AS rn,
    row_number() OVER (PARTITION BY card_id, value > 30 ORDER BY ts, seq) AS rk FROM samples),
episodes AS (
  SELECT card_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_samples, count(*) * 2.0::DOUBLE AS minutes,
    max(value) AS peak
  FROM flagged WHERE value > 30 GROUP BY card_id, rn - rk)"""


@query(
    "threshold_episodes",
    with_views(SAMPLES, RUNS, body="SELECT card_id, start_ts, end_ts, n_samples, minutes, peak FROM episodes"),
    times="start_ts end_ts",
)
def threshold_episodes(spark, sf):
    runs = series.threshold_runs(a.samples(spark, sf), ["card_id"], _ORDER)
    return runs.select("card_id", "start_ts", "end_ts", "n_samples", "minutes", "peak")


@query(
    "best_episodes",
    with_views(SAMPLES, RUNS, body="""
SELECT l.card_id, n_runs, longest_minutes, longest_leak, max_leak, max_leak_minutes FROM
  (SELECT card_id, minutes AS longest_minutes, peak AS longest_leak, count(*) OVER (PARTITION BY card_id) AS n_runs,
     row_number() OVER (PARTITION BY card_id ORDER BY minutes DESC, peak DESC) AS rn FROM episodes) l
  JOIN (SELECT card_id, peak AS max_leak, minutes AS max_leak_minutes,
     row_number() OVER (PARTITION BY card_id ORDER BY peak DESC, minutes DESC) AS rn FROM episodes) h
  ON l.card_id = h.card_id AND l.rn = 1 AND h.rn = 1"""),
)
def best_episodes(spark, sf):
    return series.best_episodes(series.threshold_runs(a.samples(spark, sf), ["card_id"], _ORDER), ["card_id"])


MASKS = """
placed AS (
  SELECT *, lag(ts) OVER w AS prev_ts, row_number() OVER w AS rn
  FROM samples WINDOW w AS (PARTITION BY card_id ORDER BY ts, seq)),
marked AS (
  SELECT *, max(CASE WHEN prev_ts IS NULL OR epoch_us(ts) - epoch_us(prev_ts) >= 28800 * 1000000::BIGINT THEN ts END)
    OVER (PARTITION BY card_id ORDER BY rn) AS start_ts FROM placed),
grouped AS (
  SELECT card_id, start_ts, max(ts) AS last_ts, max(CASE WHEN value > 10 THEN ts END) AS last_active, count(*) AS n_samples
  FROM marked GROUP BY card_id, start_ts)"""
MASK_ROWS = """
SELECT card_id, start_ts, n_samples,
  CASE WHEN epoch_us(last_ts) - epoch_us(last_active) >= 10800 * 1000000::BIGINT THEN last_active
       ELSE last_ts + INTERVAL 1 SECOND END AS end_ts
FROM grouped WHERE last_active IS NOT NULL"""


@query("mask_sessions", with_views(SAMPLES, MASKS, body=MASK_ROWS), times="start_ts end_ts")
def mask_sessions(spark, sf):
    return series.mask_sessions(
        a.samples(spark, sf), ["card_id"], _ORDER, F.col("value") > 10, gap_seconds=8 * 3600.0, tail_seconds=3 * 3600.0
    )


@query(
    "on_off_pairs",
    with_views(SAMPLES, body="""
, markers AS (
  SELECT *, event_type IN ('view', 'click', 'signup') AS is_on, floor(value) AS delta FROM samples),
clocked AS (
  SELECT *, sum(delta) OVER w AS clock FROM markers WINDOW w AS (PARTITION BY card_id ORDER BY ts, seq)),
prev AS (
  SELECT *, lag(is_on) OVER w AS was_on, lag(clock) OVER w AS from_at FROM clocked
  WINDOW w AS (PARTITION BY card_id ORDER BY ts, seq))
SELECT card_id, count(*) AS slices, sum(clock - from_at) AS used_seconds, max(clock) AS last_at
FROM prev WHERE NOT is_on AND was_on GROUP BY card_id"""),
)
def on_off_pairs(spark, sf):
    markers = a.samples(spark, sf).withColumn("delta", F.floor("value").cast("double"))
    slices = series.on_off_slices(
        markers, ["card_id"], _ORDER, "delta", F.col("event_type").isin("view", "click", "signup")
    )
    return slices.groupBy("card_id").agg(
        F.count(F.lit(1)).alias("slices"), F.sum("used").alias("used_seconds"), F.max("to_at").alias("last_at")
    )


@query(
    "locf",
    with_views(SAMPLES, body="""
SELECT card_id, seq, ts, pressure FROM (
  SELECT card_id, seq, ts, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (
    PARTITION BY card_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pressure FROM samples)
WHERE pressure IS NOT NULL"""),
    times="ts",
)
def locf(spark, sf):
    update = F.when(F.col("event_type") == "purchase", F.col("value"))
    return series.carry_forward(a.samples(spark, sf), ["card_id"], _ORDER, update, "pressure").select(
        "card_id", "seq", "ts", "pressure"
    )


@query(
    "settings_runs",
    with_views(RECORDS, DAY_SETTINGS, SETTINGS_PERIODS,
               body="SELECT card_id, run, start_day, end_day, signature, label, signed_days FROM runs"),
    days="start_day end_day",
)
def settings_runs(spark, sf):
    return periods.settings_runs(a.day_settings(spark, sf)).select(
        "card_id", "run", "start_day", "end_day", "signature", "label", "signed_days"
    )


@query(
    "settings_periods",
    with_views(RECORDS, DAY_SETTINGS, SETTINGS_PERIODS, body="""
SELECT p.card_id, p.kind, p.signature, p.label, p.period_start, p.period_end, count(*) AS days_with_data
FROM periods p JOIN day_settings d ON d.card_id = p.card_id AND d.clinical_day BETWEEN p.period_start AND p.period_end
GROUP BY ALL"""),
    days="period_start period_end",
)
def settings_periods(spark, sf):
    return periods.settings_periods(a.day_settings(spark, sf))


EPISODES = """
placed AS (
  SELECT *, max(end_ts) OVER (PARTITION BY card_id, day ORDER BY start_ts, end_ts, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until,
    row_number() OVER (PARTITION BY card_id, day ORDER BY start_ts, end_ts, seq) AS rn
  FROM (SELECT *, CAST(start_ts - INTERVAL 12 HOUR AS DATE) AS day FROM sessions)),
marked AS (
  SELECT *, max(CASE WHEN until IS NULL OR epoch(start_ts) - epoch(until) > 1800 THEN rn END)
      OVER (PARTITION BY card_id, day ORDER BY rn) AS ep,
    (epoch(end_ts) - epoch(start_ts)) / 60
      - greatest(0, least((epoch(end_ts) - epoch(start_ts)) / 60, coalesce(epoch(until) - epoch(start_ts), 0) / 60)) AS added
  FROM placed),
merged AS (
  SELECT card_id, day, min(start_ts) AS episode_start, max(end_ts) AS episode_end, sum(added) AS episode_minutes,
    count(*) AS n_sessions
  FROM marked GROUP BY card_id, day, ep)"""


@query(
    "episode_merge",
    with_views(SESSIONS, EPISODES, body="""
SELECT card_id, day, episode_start, episode_end, round(episode_minutes, 6) AS episode_minutes, n_sessions FROM merged"""),
    days="day", times="episode_start episode_end",
)
def episode_merge(spark, sf):
    sessions = sleep.timed(a.sessions(spark, sf)).withColumn("day", clinical_day("start_ts"))
    return sleep.merge_episodes(sessions, ["card_id", "day"])


DOMINANT = """
sized AS (
  SELECT *, (epoch(end_ts) - epoch(start_ts)) / 60 AS minutes,
    count(*) FILTER (epoch(end_ts) - epoch(start_ts) >= 5400) OVER (PARTITION BY card_id) AS n_long FROM sessions),
dominant AS (
  SELECT card_id, CAST(start_ts AS DATE) AS start_day, start_ts, end_ts, minutes,
    hour(start_ts) * 60 + minute(start_ts) + second(start_ts) / 60 AS start_minute
  FROM sized WHERE n_long < 3 OR minutes >= 90
  QUALIFY row_number() OVER (PARTITION BY card_id, CAST(start_ts AS DATE)
                             ORDER BY minutes DESC, start_ts, end_ts) = 1)"""


@query(
    "dominant_daily",
    with_views(SESSIONS, DOMINANT, body="""
SELECT card_id, start_day, start_ts, end_ts, round(minutes, 6) AS minutes, round(start_minute, 6) AS start_minute
FROM dominant"""),
    days="start_day", times="start_ts end_ts",
)
def dominant_daily(spark, sf):
    return sleep.dominant_days(a.sessions(spark, sf))


@query(
    "newest_by_path",
    with_views(SAMPLES, body="""
, paths AS (
  SELECT card_id, event_type || '/Part' || (seq % 13) || '/' || lpad(CAST(seq % 7 AS VARCHAR), CAST(seq % 3 + 1 AS INTEGER), '0') || '_' || seq || '.dat' AS path FROM samples),
keyed AS (
  SELECT card_id, path, list_aggregate(list_transform(regexp_extract_all(lower(path), '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]')
    THEN lpad(CAST(length(regexp_replace(r, '^0+([0-9])', '\\1')) AS VARCHAR), 4, '0') || regexp_replace(r, '^0+([0-9])', '\\1') ELSE r END), 'string_agg', '') AS key FROM paths)
SELECT card_id, arg_max(path, (key, path)) AS newest, max(path) AS last, count(*) AS n FROM keyed GROUP BY card_id"""),
)
def newest_by_path(spark, sf):
    seq = F.col("seq")
    part = F.expr("lpad(string(seq % 7), int(seq % 3 + 1), '0')")
    path = F.concat("event_type", F.lit("/Part"), (seq % 13).cast("string"), F.lit("/"), part, F.lit("_"), seq.cast("string"), F.lit(".dat"))
    return series.newest_by_path(a.samples(spark, sf).withColumn("path", path), ["card_id"])


@query(
    "drop_repeated_stamps",
    with_views(SAMPLES, body="""
SELECT card_id, seq, ts, value FROM (
  SELECT card_id, seq, date_trunc('day', ts) AS ts, value,
    row_number() OVER (PARTITION BY card_id, date_trunc('day', ts) ORDER BY seq) AS rn FROM samples) WHERE rn = 1"""),
    times="ts",
)
def drop_repeated_stamps(spark, sf):
    coarse = a.samples(spark, sf).withColumn("ts", F.date_trunc("day", "ts"))
    return series.drop_repeated_stamps(coarse, ["card_id"]).select("card_id", "seq", "ts", "value")
