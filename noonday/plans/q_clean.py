"""Queries: value ranges, validity, duplicates, unions and day sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day
from noonday.operators import cleaning as c
from noonday.operators import periods
from noonday.plans import adapters as a
from noonday.plans.adapters import DAY_SETTINGS, RECORDS, SAMPLES, SESSIONS, with_views
from noonday.plans.registry import query
from noonday.plans.sql_parts import FIELD_KIND, RECORD_DAYS, ranged, test

_FIELDS = [f for f in FIELD_KIND if f != "max_leak_duration_value"]
_SPARSE = ["usage_hours", "ahi", "leak", "leak_max", "pressure_95", "ipap_avg", "epap_95", "vt_max"]


def sparse_records(spark, sf):
    """Records with only a few of their metrics, so that many have no usable one."""
    return a.records(spark, sf).select(
        "card_id", "seq", "date",
        (F.col("usage_hours") * 8).alias("usage_hours"), (F.col("ahi") * 5).alias("ahi"),
        (F.col("leak") * 9).alias("leak"), (F.col("leak_max") * 9).alias("leak_max"),
        "pressure_95", "ipap_avg", "epap_95", (F.col("vt_max") + 2).alias("vt_max"),
    )


SPARSE = """sparse AS (
  SELECT card_id, seq, date, usage_hours * 8 AS usage_hours, ahi * 5 AS ahi, leak * 9 AS leak, leak_max * 9 AS leak_max,
    pressure_95, ipap_avg, epap_95, vt_max + 2 AS vt_max FROM records)"""


@query(
    "has_signal",
    with_views(RECORDS, SPARSE, body="SELECT card_id, seq, round(usage_hours, 6) AS usage_hours, round(leak, 6) AS leak FROM sparse WHERE "
               + " OR ".join(test(f) for f in _SPARSE)),
)
def has_signal(spark, sf):
    return c.with_signal(sparse_records(spark, sf)).select(
        "card_id", "seq", "usage_hours", "leak"
    )


@query(
    "field_ranges",
    with_views(RECORDS, body="SELECT card_id, seq, " + ", ".join(f"round({ranged(f)}, 6) AS {f}" for f in _FIELDS)
               + " FROM records"),
)
def field_ranges(spark, sf):
    return c.clip_fields(a.records(spark, sf)).select("card_id", "seq", *_FIELDS)


@query(
    "session_validity",
    with_views(SESSIONS, body="SELECT card_id, seq, start_ts, end_ts FROM sessions"),
    times="start_ts end_ts",
)
def session_validity(spark, sf):
    return a.sessions(spark, sf).select("card_id", "seq", "start_ts", "end_ts")


SETTINGS_PERIODS = """
signed AS (
  SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY clinical_day)
    - row_number() OVER (PARTITION BY card_id, signature ORDER BY clinical_day) AS g FROM day_settings),
runs AS (
  SELECT card_id, min(clinical_day) AS start_day, max(clinical_day) AS end_day, any_value(signature) AS signature,
    any_value(label) AS label, count(*) AS signed_days,
    row_number() OVER (PARTITION BY card_id ORDER BY min(clinical_day)) AS run
  FROM signed GROUP BY card_id, signature, g),
last_runs AS (
  SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY run DESC) AS back FROM runs),
periods AS (
  SELECT card_id, CASE WHEN back = 1 THEN 'current' ELSE 'previous' END AS kind, signature, label,
    greatest(start_day, end_day - 89) AS period_start, end_day AS period_end
  FROM last_runs WHERE back <= 2)
"""


@query(
    "period_sessions",
    with_views(RECORDS, DAY_SETTINGS, SETTINGS_PERIODS, SESSIONS, body="""
SELECT s.card_id, s.seq, p.kind, s.start_ts
FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN CAST(start_ts - INTERVAL 12 HOUR AS DATE) + CAST(seq % 3 AS INTEGER) END AS src
      FROM sessions) s JOIN periods p USING (card_id)
WHERE CASE WHEN src IS NOT NULL THEN src BETWEEN period_start AND period_end
  ELSE CAST(start_ts - INTERVAL 12 HOUR AS DATE) BETWEEN period_start AND period_end
    OR CAST(start_ts AS DATE) BETWEEN period_start AND period_end END"""),
    times="start_ts",
)
def period_sessions(spark, sf):
    source = F.when(F.col("seq") % 2 == 0, F.date_add(clinical_day("start_ts"), (F.col("seq") % 3).cast("int")))
    sessions = a.sessions(spark, sf).withColumn("source_clinical_day", source)
    own = periods.settings_periods(a.day_settings(spark, sf))
    return c.sessions_in_period(sessions, own).select("card_id", "seq", "kind", "start_ts")


_SIGNATURE = ["usage_hours", "leak", "ahi"]


DISTINCT_RECORDS = """
distinct_records AS (
  SELECT card_id, seq, date, copies FROM (
    SELECT *, count(*) OVER (PARTITION BY card_id, CAST(date AS DATE), leak, ahi, settings_signature) AS copies,
      row_number() OVER (PARTITION BY card_id, CAST(date AS DATE), leak, ahi, settings_signature ORDER BY seq) AS rn
    FROM (SELECT card_id, seq, date, round(floor(leak / 40), 3) AS leak, round(mod(central_apneas * 8, 3), 3) AS ahi,
                 settings_signature FROM records))
  WHERE rn = 1)"""


@query(
    "record_dedupe",
    with_views(RECORDS, DISTINCT_RECORDS, body="SELECT * FROM distinct_records"),
    times="date",
)
def record_dedupe(spark, sf):
    return c.distinct_records(coarse_records(spark, sf)).select("card_id", "seq", "date", "copies")


def coarse_records(spark, sf):
    """Records with two rough metrics only, so that many of a date are equal."""
    return a.records(spark, sf).select(
        "card_id", "seq", "date", F.floor(F.col("leak") / 40).cast("double").alias("leak"),
        (F.col("central_apneas") * 8 % 3).alias("ahi"), "settings_signature",
    )


@query(
    "union_records",
    with_views(RECORDS, SESSIONS, body="""
SELECT card_id, seq, date, round(usage_hours, 6) AS usage_hours, round(leak, 6) AS leak, NULL::DOUBLE AS session_minutes
FROM records
UNION ALL
SELECT card_id, seq, start_ts, NULL, NULL, round((epoch(end_ts) - epoch(start_ts)) / 60, 6) FROM sessions
UNION ALL
SELECT card_id, seq, date, NULL, round(leak_95, 6), NULL FROM records WHERE leak_95 IS NOT NULL"""),
    times="date",
)
def union_records(spark, sf):
    records = a.records(spark, sf)
    timing = a.sessions(spark, sf).select(
        "card_id", "seq", F.col("start_ts").alias("date"),
        ((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 60e6).alias("session_minutes"),
    )
    waves = records.where("leak_95 IS NOT NULL").select("card_id", "seq", "date", F.col("leak_95").alias("leak"))
    return c.union_records(records.select("card_id", "seq", "date", "usage_hours", "leak"), timing, waves)


SAMPLE_DAYS = """
sample_days AS (SELECT card_id, CAST(ts - INTERVAL 12 HOUR AS DATE) AS clinical_day, event_type FROM samples)"""


def day_rows(spark, sf, kinds):
    return a.samples(spark, sf).where(F.col("event_type").isin(*kinds)).withColumn("clinical_day", clinical_day("ts"))


@query(
    "valid_days_intersect",
    with_views(SAMPLES, SAMPLE_DAYS, body="""
SELECT card_id, clinical_day FROM sample_days WHERE event_type IN ('view', 'click')
INTERSECT SELECT card_id, clinical_day FROM sample_days WHERE event_type IN ('error', 'signup', 'purchase')"""),
    days="clinical_day",
)
def valid_days_intersect(spark, sf):
    return c.days_in_both(day_rows(spark, sf, ["view", "click"]), day_rows(spark, sf, ["error", "signup", "purchase"]))


@query(
    "days_except",
    with_views(SAMPLES, SAMPLE_DAYS, body="""
SELECT card_id, clinical_day FROM sample_days WHERE event_type IN ('view', 'click')
EXCEPT SELECT card_id, clinical_day FROM sample_days WHERE event_type IN ('error', 'signup', 'purchase')"""),
    days="clinical_day",
)
def days_except(spark, sf):
    left = day_rows(spark, sf, ["view", "click"]).select("card_id", "clinical_day").distinct()
    return c.days_only_in(left, day_rows(spark, sf, ["error", "signup", "purchase"]))


@query(
    "available_days_union",
    with_views(*RECORD_DAYS, body="""
SELECT card_id, min(day) AS first_day, count(DISTINCT day) AS n_days FROM (
  SELECT card_id, clinical_day AS day FROM days
  UNION ALL SELECT card_id, min(clinical_day) - CAST(card_id % 5 AS INTEGER) FROM days GROUP BY card_id)
GROUP BY card_id"""),
    days="first_day",
)
def available_days_union(spark, sf):
    days = a.records(spark, sf).select("card_id", clinical_day("date").alias("clinical_day"))
    history = days.groupBy("card_id").agg(F.min("clinical_day").alias("d")).select(
        "card_id", F.date_sub("d", (F.col("card_id") % 5).cast("int")).alias("history_start")
    )
    return c.first_available_day(days, history)


@query(
    "session_dedupe_exact",
    with_views(SESSIONS, body="""
SELECT DISTINCT card_id, start_ts, end_ts FROM (
  SELECT card_id, date_trunc('hour', start_ts) AS start_ts, date_trunc('hour', end_ts) + INTERVAL 1 HOUR AS end_ts
  FROM sessions)"""),
    times="start_ts end_ts",
)
def session_dedupe_exact(spark, sf):
    coarse = a.sessions(spark, sf).select(
        "card_id", F.date_trunc("hour", "start_ts").alias("start_ts"),
        (F.date_trunc("hour", "end_ts") + F.expr("INTERVAL 1 HOUR")).alias("end_ts"),
    )
    return c.distinct_sessions(coarse)


def walked(source: str, out: str) -> str:
    """SQL views: ``out``, the sessions of each ``card_id`` of ``source`` that a walk by start and end keeps."""
    return f"""
{out}_lists AS (
  SELECT card_id, list({{'s': s, 'e': e}} ORDER BY s, e) AS l
  FROM (SELECT DISTINCT card_id, epoch_us(start_ts) AS s, epoch_us(end_ts) AS e FROM {source}) GROUP BY card_id),
{out}_walked AS (
  SELECT card_id, list_reduce(
    list_transform(l, lambda x: [x]),
    lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: abs(k.s - x[1].s) <= 120000000 AND abs(k.e - x[1].e) <= 120000000)) > 0
      THEN kept ELSE list_concat(kept, x) END,
    CAST([] AS STRUCT(s BIGINT, e BIGINT)[])) AS kept FROM {out}_lists),
{out} AS (
  SELECT card_id, make_timestamp(k.s) AS start_ts, make_timestamp(k.e) AS end_ts FROM (SELECT card_id, unnest(kept) AS k FROM {out}_walked))"""


DOUBLED = """
doubled AS (
  SELECT card_id, start_ts + to_seconds(n) AS start_ts, end_ts + to_seconds(n) AS end_ts FROM sessions, (VALUES (0), (90), (150)) AS t(n))"""


@query(
    "session_dedupe_fuzzy",
    with_views(SESSIONS, DOUBLED, walked("doubled", "distinct_fuzzy"), body="SELECT card_id, start_ts, end_ts FROM distinct_fuzzy"),
    times="start_ts end_ts",
)
def session_dedupe_fuzzy(spark, sf):
    return c.fuzzy_distinct_sessions(doubled_sessions(spark, sf))


def doubled_sessions(spark, sf):
    """Every session, and copies shifted by 90 and 150 seconds."""
    from noonday.functions.dates import shift_seconds

    base = a.sessions(spark, sf).select("card_id", "start_ts", "end_ts")
    shifts = F.explode(F.array(*[F.lit(n) for n in (0, 90, 150)]))
    return base.withColumn("shift", shifts).select(
        "card_id",
        shift_seconds("start_ts", F.col("shift")).alias("start_ts"),
        shift_seconds("end_ts", F.col("shift")).alias("end_ts"),
    )


@query(
    "in_window",
    with_views(*RECORD_DAYS, body="""
SELECT card_id, clinical_day, round(usage_hours_sum, 6) AS usage_hours FROM days
WHERE clinical_day >= DATE '2024-01-08' AND clinical_day < DATE '2024-01-22'"""),
    days="clinical_day",
)
def in_window(spark, sf):
    from noonday.operators.rollup import day_parts

    inside = (F.col("clinical_day") >= F.lit("2024-01-08").cast("date")) & (
        F.col("clinical_day") < F.lit("2024-01-22").cast("date")
    )
    return day_parts(a.records(spark, sf)).where(inside).select(
        "card_id", "clinical_day", F.col("usage_hours_sum").alias("usage_hours")
    )


@query(
    "support_gate",
    """
SELECT c_custkey AS card_id, c_mktsegment AS family,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unrecognised' WHEN c_mktsegment = 'FURNITURE' THEN 'unsupported'
       ELSE 'ok' END AS state
FROM customer""",
)
def support_gate(spark, sf):
    from noonday.operators.catalogue import support_state

    cards = a.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("card_id"), F.col("c_mktsegment").alias("family")
    )
    family = F.when(F.col("family") != "MACHINERY", F.col("family"))
    return cards.withColumn("state", support_state(family, family != "FURNITURE"))
