"""Queries: sleep-timing inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from noonday.functions.circular import clock_distance, clock_text, hours_text
from noonday.functions.dates import minute_of_day
from noonday.operators import sleep
from noonday.plans import adapters as a
from noonday.plans.adapters import SESSIONS, with_views
from noonday.plans.q_series import DOMINANT
from noonday.plans.registry import query


def _distance(x: str, y: str) -> str:
    return f"least(abs({x} - {y}), 1440 - abs({x} - {y}))"


ANCHOR = f"""
counted AS (SELECT *, count(*) OVER (PARTITION BY card_id) AS observed,
  sqrt(least(720, minutes) / 60) AS w FROM dominant),
scores AS (
  SELECT c.card_id, c.start_ts, c.start_minute AS candidate, any_value(c.observed) AS observed,
    round(sum(exp(-0.5 * power({_distance('c.start_minute', 's.start_minute')} / 150, 2)) * s.w), 9) AS score
  FROM counted c JOIN counted s USING (card_id) WHERE c.observed >= 3 GROUP BY c.card_id, c.start_ts, c.start_minute),
picked AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY score DESC, start_ts) = 1),
near AS (
  SELECT d.card_id, p.candidate, p.observed, d.start_minute, d.w, d.minutes,
    d.start_minute / 1440 * 2 * pi() AS rad
  FROM counted d JOIN picked p USING (card_id) WHERE {_distance('p.candidate', 'd.start_minute')} <= 240),
centred AS (
  SELECT card_id, any_value(observed) AS observed, any_value(candidate) AS candidate, count(*) AS supporting,
    sum(cos(rad) * w) AS x, sum(sin(rad) * w) AS y, sum(w) AS total_w
  FROM near GROUP BY card_id HAVING count(*) >= 2),
anchored AS (
  SELECT *, round(CASE WHEN abs(x) < 1e-9 AND abs(y) < 1e-9 THEN candidate
    ELSE (atan2(y, x) / (2 * pi()) * 1440 + 1440) % 1440 END, 9) AS anchor FROM centred),
spread AS (
  SELECT a.card_id, round(greatest(0, 1 - avg({_distance('a.anchor', 'n.start_minute')}) / 240), 9) AS concentration
  FROM anchored a JOIN near n USING (card_id) GROUP BY a.card_id),
medians AS (
  SELECT card_id, min(minutes) FILTER (round(cum, 9) >= round(total_w / 2, 9)) AS median_minutes FROM (
    SELECT n.card_id, n.minutes, a.total_w, sum(n.w) OVER (PARTITION BY n.card_id ORDER BY n.minutes, n.start_minute, n.w
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
    FROM near n JOIN anchored a USING (card_id)) GROUP BY card_id)
"""


@query(
    "anchor_kernel",
    with_views(SESSIONS, DOMINANT, ANCHOR, body="""
SELECT card_id, observed AS observed_days, round(candidate, 6) AS candidate, round(score, 6) AS score FROM picked"""),
)
def anchor_kernel(spark, sf):
    return sleep.anchor_candidates(sleep.dominant_days(a.sessions(spark, sf))).drop("days")


@query(
    "anchor_inliers",
    with_views(SESSIONS, DOMINANT, ANCHOR, body="""
SELECT card_id, count(*) AS inliers, round(sum(minutes), 6) AS minutes FROM near GROUP BY card_id"""),
)
def anchor_inliers(spark, sf):
    near = sleep.inliers(sleep.anchor_candidates(sleep.dominant_days(a.sessions(spark, sf))))
    return near.groupBy("card_id").agg(F.count(F.lit(1)).alias("inliers"), F.sum("minutes").alias("minutes"))


@query(
    "sleep_anchor",
    with_views(SESSIONS, DOMINANT, ANCHOR, body="""
SELECT a.card_id, a.observed AS observed_days, a.supporting AS supporting_days, round(a.candidate, 6) AS candidate,
  round(a.anchor, 6) AS anchor, round(s.concentration, 6) AS concentration, round(m.median_minutes, 6) AS median_minutes
FROM anchored a JOIN spread s USING (card_id) JOIN medians m USING (card_id)"""),
)
def sleep_anchor(spark, sf):
    """Circular mean, concentration and weighted median of the inliers."""
    return sleep.anchors(sleep.dominant_days(a.sessions(spark, sf)))


def _side(name: str, test: str) -> str:
    """The anchor chain over the sessions of one side of the drift cut, under prefixed view names."""
    text = DOMINANT.strip() + "," + ANCHOR.strip()
    for view in ("sized", "dominant", "counted", "scores", "picked", "near", "centred", "anchored", "spread", "medians"):
        for left, right in ((f"{view} AS (", f"{name}_{view} AS ("), (f"FROM {view} ", f"FROM {name}_{view} "),
                            (f"FROM {view})", f"FROM {name}_{view})"), (f"FROM {view},", f"FROM {name}_{view},"),
                            (f"JOIN {view} ", f"JOIN {name}_{view} "), (f"FROM {view}\n", f"FROM {name}_{view}\n")):
            text = text.replace(left, right)
    return f"{name}_src AS (SELECT s.* FROM sessions s JOIN cut USING (card_id) WHERE {test}),\n" + text.replace(
        "FROM sessions", f"FROM {name}_src"
    )


DRIFT = (
    """cut AS (SELECT card_id, max(start_ts) - INTERVAL 14 DAY AS cutoff, count(*) AS n FROM sessions GROUP BY card_id
  HAVING count(*) >= 14),
""" + _side("r", "start_ts >= cutoff") + ",\n" + _side("p", "start_ts < cutoff") + f""",
drift AS (
  SELECT c.card_id, r.anchor AS recent_anchor, p.anchor AS prior_anchor,
    coalesce({_distance('r.anchor', 'p.anchor')} >= 240, false) AS drift
  FROM (SELECT DISTINCT card_id FROM sessions) c
  LEFT JOIN (SELECT * FROM r_anchored WHERE observed >= 5) r USING (card_id)
  LEFT JOIN (SELECT * FROM p_anchored WHERE observed >= 5) p USING (card_id))"""
)


@query(
    "schedule_drift",
    with_views(SESSIONS, DRIFT, body="""
SELECT card_id, round(recent_anchor, 6) AS recent_anchor, round(prior_anchor, 6) AS prior_anchor, drift FROM drift"""),
)
def schedule_drift(spark, sf):
    return sleep.schedule_drift(a.sessions(spark, sf).select("card_id", "start_ts", "end_ts"))


PROFILE = """
profile AS (
  SELECT a.card_id, floor(a.anchor + 0.5) AS anchor_minutes, floor(least(720, greatest(60, m.median_minutes)) + 0.5) AS typical_minutes,
    greatest(0, least(1, 0.5 * a.supporting / a.observed + 0.3 * s.concentration + 0.2 * least(1, a.observed / 14)
      - CASE WHEN d.drift THEN 0.2 ELSE 0 END)) AS score,
    a.supporting AS supporting_days, a.observed AS observed_days, d.drift
  FROM anchored a JOIN spread s USING (card_id) JOIN medians m USING (card_id) JOIN drift d USING (card_id)),
profiles AS (
  SELECT card_id, anchor_minutes, typical_minutes, (anchor_minutes + typical_minutes) % 1440 AS window_end_minutes,
    (anchor_minutes - 480 + 1440) % 1440 AS boundary_minutes, score AS confidence_score,
    CASE WHEN round(score, 9) >= 0.75 THEN 'high' WHEN round(score, 9) >= 0.5 THEN 'moderate' ELSE 'low' END AS confidence,
    supporting_days, observed_days, drift FROM profile)"""

PROFILE_VIEWS = (SESSIONS, DOMINANT, ANCHOR, DRIFT, PROFILE)


@query(
    "sleep_profile",
    with_views(*PROFILE_VIEWS, body="""
SELECT * REPLACE (round(confidence_score, 6) AS confidence_score, anchor_minutes::DOUBLE AS anchor_minutes) FROM profiles"""),
)
def sleep_profile(spark, sf):
    return sleep.sleep_profiles(a.sessions(spark, sf).select("card_id", "start_ts", "end_ts"))


CLASSIFY = f"""
placed_sessions AS (
  SELECT s.card_id, s.seq, s.start_ts, s.end_ts, p.anchor_minutes, (epoch(end_ts) - epoch(start_ts)) / 60 AS minutes,
    CASE WHEN hour(start_ts) * 60 + minute(start_ts) + second(start_ts) / 60 < p.boundary_minutes
         THEN CAST(start_ts AS DATE) - 1 ELSE CAST(start_ts AS DATE) END AS sleep_day
  FROM sessions s JOIN profiles p USING (card_id)),
seen AS (
  SELECT *, max(end_ts) OVER (PARTITION BY card_id, sleep_day ORDER BY start_ts, end_ts, seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until,
    row_number() OVER (PARTITION BY card_id, sleep_day ORDER BY start_ts, end_ts, seq) AS rn FROM placed_sessions),
opened AS (
  SELECT *, max(CASE WHEN until IS NULL OR epoch(start_ts) - epoch(until) > 1800 THEN rn END)
      OVER (PARTITION BY card_id, sleep_day ORDER BY rn) AS ep,
    CASE WHEN until IS NULL OR epoch(start_ts) - epoch(until) > 1800 THEN minutes
         ELSE greatest(0, minutes - greatest(0, (epoch(until) - epoch(start_ts)) / 60)) END AS added FROM seen),
eps AS (
  SELECT card_id, sleep_day, min(start_ts) AS episode_start, sum(added) AS m, any_value(anchor_minutes) AS anchor_minutes
  FROM opened GROUP BY card_id, sleep_day, ep),
measured AS (
  SELECT *, hour(episode_start) * 60 + minute(episode_start) + second(episode_start) / 60 AS mod_ FROM eps),
dist AS (SELECT *, {_distance('(anchor_minutes % 1440)', 'mod_')} AS d FROM measured),
principal AS (
  SELECT card_id, sleep_day, m AS principal_minutes FROM dist WHERE d <= 360 OR m >= 240
  QUALIFY row_number() OVER (PARTITION BY card_id, sleep_day
    ORDER BY round(m * (1 + 0.5 * exp(-0.5 * power(d / 180, 2))), 9) DESC, episode_start) = 1),
sleep_days AS (
  SELECT e.card_id, e.sleep_day, count(*) AS n_episodes, sum(e.m) AS total_minutes,
    coalesce(any_value(p.principal_minutes), 0) AS principal_minutes
  FROM eps e LEFT JOIN principal p USING (card_id, sleep_day) GROUP BY e.card_id, e.sleep_day)"""


@query(
    "sleep_days",
    with_views(*PROFILE_VIEWS, CLASSIFY, body="""
SELECT card_id, sleep_day, n_episodes, round(total_minutes, 6) AS total_minutes, round(principal_minutes, 6) AS principal_minutes,
  round(greatest(0, total_minutes - principal_minutes), 6) AS nap_minutes, principal_minutes >= 240 AS four_hours
FROM sleep_days"""),
    days="sleep_day",
)
def sleep_days(spark, sf):
    sessions = a.sessions(spark, sf).select("card_id", "start_ts", "end_ts")
    return sleep.classify_days(sleep.with_sleep_day(sessions, sleep.sleep_profiles(sessions)))


@query(
    "touches_window",
    with_views(*PROFILE_VIEWS, CLASSIFY, body="""
SELECT card_id, sleep_day, bool_or((sleep_day >= DATE '2024-01-10' AND sleep_day < DATE '2024-01-17')
  OR (CAST(start_ts AS DATE) >= DATE '2024-01-10' AND CAST(start_ts AS DATE) < DATE '2024-01-17')
  OR (CAST(start_ts - INTERVAL 12 HOUR AS DATE) >= DATE '2024-01-10'
      AND CAST(start_ts - INTERVAL 12 HOUR AS DATE) < DATE '2024-01-17')) AS touches
FROM placed_sessions GROUP BY card_id, sleep_day"""),
    days="sleep_day",
)
def touches_window(spark, sf):
    sessions = a.sessions(spark, sf).select("card_id", "start_ts", "end_ts")
    placed = sleep.with_sleep_day(sessions, sleep.sleep_profiles(sessions))
    first, end = F.lit("2024-01-10").cast("date"), F.lit("2024-01-17").cast("date")
    return sleep.touched_days(placed, first, end)


@query(
    "sleep_day_totals",
    with_views(*PROFILE_VIEWS, CLASSIFY, body="""
SELECT card_id, round(sum(total_minutes), 6) AS total_minutes, round(sum(principal_minutes), 6) AS principal_minutes,
  round(sum(greatest(0, total_minutes - principal_minutes)), 6) AS nap_minutes,
  count(*) FILTER (principal_minutes >= 240) AS timed_compliant_days, count(*) FILTER (total_minutes > 0) AS timed_days,
  count(*) AS n_sleep_days FROM sleep_days GROUP BY card_id"""),
)
def sleep_day_totals(spark, sf):
    sessions = a.sessions(spark, sf).select("card_id", "start_ts", "end_ts")
    placed = sleep.with_sleep_day(sessions, sleep.sleep_profiles(sessions))
    return sleep.classify_totals(sleep.classify_days(placed))


@query(
    "circular_distance",
    with_views(SESSIONS, body=f"""
, m AS (SELECT card_id, seq, hour(start_ts) * 60 + minute(start_ts) + second(start_ts) / 60 AS s,
  hour(end_ts) * 60 + minute(end_ts) + second(end_ts) / 60 AS e FROM sessions)
SELECT card_id, seq, round({_distance('s', 'e')}, 6) AS distance FROM m"""),
)
def circular_distance(spark, sf):
    return a.sessions(spark, sf).select(
        "card_id", "seq", clock_distance(minute_of_day("start_ts"), minute_of_day("end_ts")).alias("distance")
    )


@query(
    "format_clock",
    """
WITH m AS (SELECT event_id, value, CAST(floor((value * 70) % 1440 + 0.5) AS BIGINT) % 1440 AS m,
  CAST(floor(value / 20 * 60 + 0.5) AS BIGINT) AS t FROM events)
SELECT event_id, CASE WHEN (m // 60) % 12 = 0 THEN 12 ELSE (m // 60) % 12 END || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0')
  || CASE WHEN m // 60 >= 12 THEN ' PM' ELSE ' AM' END AS clock,
  t // 60 || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') AS duration FROM m""",
)
def format_clock(spark, sf):
    return a.read(spark, sf, "events").select(
        "event_id", clock_text(F.col("value") * 70).alias("clock"), hours_text(F.col("value") / 20).alias("duration")
    )
