"""Queries: joins of samples, events, markers and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day
from noonday.operators import matching as m
from noonday.operators import rollup
from noonday.plans import adapters as a
from noonday.plans.adapters import RECORDS, SAMPLES, SESSIONS, with_views
from noonday.plans.registry import query
from noonday.plans.sql_parts import RECORD_DAYS

DAY = ["card_id", "clinical_day"]


def event_days(spark, sf):
    """Event counts per card and clinical day."""

    def n(kind):
        return F.count_if(F.col("event_type") == kind)

    days = a.samples(spark, sf).withColumn("clinical_day", clinical_day("ts"))
    return days.groupBy(*DAY).agg(
        F.count_if(F.col("event_type").isin("click", "error", "view")).alias("event_count"),
        F.count_if(F.col("event_type").isin("click", "error", "view")).alias("apneas"),
        n("error").alias("centrals"),
        n("click").alias("obstructives"),
    )


EVENT_DAYS = """
event_days AS (
  SELECT card_id, CAST(ts - INTERVAL 12 HOUR AS DATE) AS clinical_day,
    count(*) FILTER (event_type IN ('click', 'error', 'view')) AS n, count(*) FILTER (event_type = 'error') AS centrals,
    count(*) FILTER (event_type = 'click') AS obstructives
  FROM samples GROUP BY ALL)"""


@query(
    "event_override",
    with_views(RECORDS, SAMPLES, EVENT_DAYS, body="""
SELECT r.card_id, r.seq, round(CASE WHEN n > 0 AND usage_hours > 0 THEN n / usage_hours ELSE ahi END, 6) AS ahi
FROM records r LEFT JOIN event_days e
  ON r.card_id = e.card_id AND CAST(r.date - INTERVAL 12 HOUR AS DATE) = e.clinical_day"""),
)
def event_override(spark, sf):
    sessions = a.records(spark, sf).select(
        "card_id", "seq", clinical_day("date").alias("clinical_day"), "usage_hours", "ahi"
    )
    out = m.override_ahi(sessions, event_days(spark, sf), DAY)
    return out.select("card_id", "seq", "ahi")


@query(
    "fill_from_events",
    with_views(RECORDS, SAMPLES, EVENT_DAYS, body="""
SELECT r.card_id, r.seq,
  round(coalesce(residual_apneas, CASE WHEN usage_hours > 0 AND usage_hours <= 24 THEN n / usage_hours END), 6) AS residual,
  round(coalesce(CASE WHEN r.seq % 2 = 0 THEN central_apneas END,
    CASE WHEN centrals + obstructives > 0 AND n = centrals + obstructives AND usage_hours > 0 AND usage_hours <= 24
         THEN centrals / usage_hours END), 6) AS central
FROM records r LEFT JOIN event_days e
  ON r.card_id = e.card_id AND CAST(r.date - INTERVAL 12 HOUR AS DATE) = e.clinical_day"""),
)
def fill_from_events(spark, sf):
    records = a.records(spark, sf).select(
        "card_id", "seq", clinical_day("date").alias("clinical_day"), "usage_hours", "residual_apneas",
        F.when(F.col("seq") % 2 == 0, F.col("central_apneas")).alias("central_apneas"),
    )
    out = m.fill_from_events(records, event_days(spark, sf).drop("event_count"), DAY)
    return out.select(
        "card_id", "seq", F.col("residual_apneas").alias("residual"), F.col("central_apneas").alias("central")
    )


@query(
    "fill_missing_days",
    with_views(RECORDS, SAMPLES, body="""
, summary AS (
  SELECT card_id, CAST(date - INTERVAL 12 HOUR AS DATE) AS clinical_day, avg(leak_95) AS leak FROM records GROUP BY ALL),
sampled AS (
  SELECT card_id, CAST(ts - INTERVAL 12 HOUR AS DATE) AS clinical_day, avg(value) AS leak FROM samples GROUP BY ALL)
SELECT card_id, clinical_day, round(leak, 6) AS leak, 'summary' AS source FROM summary WHERE leak IS NOT NULL
UNION ALL
SELECT s.card_id, s.clinical_day, round(s.leak, 6), 'samples' FROM sampled s
WHERE NOT EXISTS (SELECT 1 FROM summary d WHERE d.card_id = s.card_id AND d.clinical_day = s.clinical_day
                  AND d.leak IS NOT NULL)"""),
    days="clinical_day",
)
def fill_missing_days(spark, sf):
    summary = a.records(spark, sf).groupBy("card_id", clinical_day("date").alias("clinical_day")).agg(
        F.avg("leak_95").alias("leak")
    )
    sampled = a.samples(spark, sf).groupBy("card_id", clinical_day("ts").alias("clinical_day")).agg(
        F.avg("value").alias("leak")
    )
    return m.fill_missing_days(summary, sampled, "leak", DAY)


@query(
    "interval_join",
    with_views(SAMPLES, SESSIONS, body="""
SELECT card_id, seq, start_ts, end_ts FROM (
  SELECT p.card_id, p.seq, s.start_ts, s.end_ts,
    row_number() OVER (PARTITION BY p.seq ORDER BY s.start_ts, s.end_ts) AS rn
  FROM samples p JOIN sessions s ON p.card_id = s.card_id AND p.ts >= s.start_ts AND p.ts <= s.end_ts)
WHERE rn = 1"""),
    times="start_ts end_ts",
)
def interval_join(spark, sf):
    return m.assign_to_sessions(a.samples(spark, sf), a.sessions(spark, sf), ["seq"])


SLICES = """
slices AS (
  SELECT o_orderkey AS slice_no, o_custkey % 97 AS file_id, CAST(floor(o_totalprice) AS BIGINT) AS from_offset,
    CAST(floor(o_totalprice) AS BIGINT) + 400 + o_orderkey % 4000 AS to_offset
  FROM orders),
recs AS (
  SELECT o_orderkey AS rec, o_custkey % 97 AS file_id, CAST(floor(o_totalprice / 2) AS BIGINT) * 2 AS off FROM orders)"""


@query(
    "offset_range_join",
    with_views(SLICES, body="""
SELECT r.file_id, r.rec, min(s.slice_no) AS slice_no
FROM recs r JOIN slices s ON r.file_id = s.file_id AND r.off >= s.from_offset // 32 * 32 AND r.off < s.to_offset
GROUP BY r.file_id, r.rec"""),
)
def offset_range_join(spark, sf):
    orders = a.read(spark, sf, "orders").withColumn("file_id", F.col("o_custkey") % 97)
    start = F.floor("o_totalprice")
    slices = orders.select(
        "file_id", F.col("o_orderkey").alias("slice_no"), start.alias("from_offset"),
        (start + 400 + F.col("o_orderkey") % 4000).alias("to_offset"),
    )
    records = orders.select(
        "file_id", F.col("o_orderkey").alias("rec"), (F.floor(F.col("o_totalprice") / 2) * 2).alias("offset")
    )
    return m.assign_to_slices(records, slices, ["file_id"], "rec", record_size=32)


@query(
    "nearest_day",
    with_views(*RECORD_DAYS, SAMPLES, body="""
, usable AS (
  SELECT card_id, clinical_day AS day, least(24, usage_hours_sum) AS usage_hours FROM days),
points AS (SELECT card_id, seq, ts FROM samples),
cand AS (
  SELECT p.card_id, p.seq, u.day,
    greatest(0, epoch_us(CAST(u.day AS TIMESTAMP) + INTERVAL 12 HOUR) - epoch_us(p.ts),
      epoch_us(p.ts) - epoch_us(CAST(u.day AS TIMESTAMP) + INTERVAL 36 HOUR)) / 1000000.0 AS distance
  FROM points p JOIN usable u ON p.card_id = u.card_id
  WHERE (p.ts >= CAST(u.day AS TIMESTAMP)
     AND epoch_us(p.ts) <= epoch_us(CAST(u.day AS TIMESTAMP) + INTERVAL 12 HOUR)
       + CAST(trunc((coalesce(usage_hours, 1) + 12) * 3600000000) AS BIGINT))
     OR abs(date_diff('day', u.day, CAST(p.ts AS DATE))) <= 1)
SELECT card_id, seq, day, round(distance, 6) AS distance_seconds FROM (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY distance, day) AS rn FROM cand) WHERE rn = 1"""),
    days="day",
)
def nearest_day(spark, sf):
    days = rollup.day_parts(a.records(spark, sf)).select(
        "card_id", F.col("clinical_day").alias("day"), F.least(F.lit(24.0), "usage_hours_sum").alias("usage_hours")
    )
    points = a.samples(spark, sf).select("card_id", "seq", "ts")
    return m.assign_to_nearest_day(points, days, "seq")


@query(
    "exact_session_join",
    with_views(SAMPLES, SESSIONS, body="""
SELECT s.card_id, s.seq, p.seq AS marker, p.event_type AS kind FROM sessions s
JOIN samples p ON s.card_id = p.card_id AND s.start_ts = date_trunc('second', p.ts)"""),
)
def exact_session_join(spark, sf):
    markers = a.samples(spark, sf).select(
        "card_id", F.date_trunc("second", "ts").alias("start_ts"), F.col("seq").alias("marker"),
        F.col("event_type").alias("kind"),
    )
    return a.sessions(spark, sf).join(markers, ["card_id", "start_ts"]).select("card_id", "seq", "marker", "kind")


@query(
    "pair_by_ordinal",
    with_views(SAMPLES, body="""
, marks AS (
  SELECT card_id, CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, ts, event_type IN ('view', 'click', 'signup') AS is_start,
    row_number() OVER (PARTITION BY card_id, CAST(ts - INTERVAL 12 HOUR AS DATE), event_type IN ('view', 'click', 'signup')
                       ORDER BY ts, seq) AS ordinal
  FROM samples),
pairs AS (
  SELECT s.card_id, s.day, s.ordinal, s.ts AS start_ts, e.ts AS end_ts, (epoch_us(e.ts) - epoch_us(s.ts)) / 1000000.0 AS seconds
  FROM marks s JOIN marks e ON s.card_id = e.card_id AND s.day = e.day AND s.ordinal = e.ordinal
    AND s.is_start AND NOT e.is_start
  WHERE e.ts > s.ts AND epoch_us(e.ts) - epoch_us(s.ts) <= 86400 * 1000000::BIGINT)
SELECT card_id, day, ordinal, start_ts, end_ts, round(seconds, 6) AS seconds, round(total, 6) AS total_seconds FROM (
  SELECT *, sum(seconds) OVER (PARTITION BY card_id, day) AS total FROM pairs) WHERE total <= 86400"""),
    days="day", times="start_ts end_ts",
)
def pair_by_ordinal(spark, sf):
    marks = a.samples(spark, sf).withColumn("day", clinical_day("ts"))
    pairs = m.pair_markers(
        marks, ["card_id", "day"], ["ts", "seq"], F.col("event_type").isin("view", "click", "signup")
    )
    return pairs


@query(
    "two_phase_semi",
    """
WITH s AS (SELECT o_custkey AS card_id, o_orderkey AS session_id, o_orderdate AS start_ts FROM orders),
n AS (SELECT card_id, max(CAST(start_ts - INTERVAL 12 HOUR AS DATE)) AS newest FROM s GROUP BY card_id),
r AS (SELECT s.* FROM s JOIN n USING (card_id) WHERE CAST(start_ts - INTERVAL 12 HOUR AS DATE) >= newest - 180)
SELECT r.card_id, r.session_id, count(*) AS events, round(sum(l_quantity), 6) AS total
FROM lineitem JOIN r ON l_orderkey = session_id GROUP BY ALL""",
)
def two_phase_semi(spark, sf):
    sessions = a.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("card_id"), F.col("o_orderkey").alias("session_id"),
        F.col("o_orderdate").alias("start_ts"),
    )
    recent = m.recent_sessions(sessions, 181).select("card_id", "session_id")
    events = a.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), "l_quantity")
    return events.join(recent, "session_id").groupBy("card_id", "session_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("l_quantity").alias("total")
    )


@query(
    "trusted_hints",
    with_views(a.FILES, body="""
, hints AS (
  SELECT card_id, CAST('0x' || regexp_extract(lower(replace(path, '\\', '/')), '(?:^|/)p[0-9]+/([0-9a-f]{8})\\.(?:000|001|002|b01|b02)$', 1) AS BIGINT) AS hint
  FROM files WHERE regexp_matches(lower(replace(path, '\\', '/')), '(?:^|/)p[0-9]+/([0-9a-f]{8})\\.(?:000|001|002|b01|b02)$')),
known AS (SELECT DISTINCT o_custkey // 10 + CASE WHEN o_orderkey % 7 = 0 THEN 1000000 ELSE 0 END AS card_id, o_orderkey AS hint FROM orders)
SELECT h.card_id, count(*) AS hinted, count(k.hint) AS matched, count(k.hint) > 0 AND count(k.hint) / count(*) >= 0.8 AS trusted
FROM hints h LEFT JOIN known k ON h.card_id = k.card_id AND h.hint = k.hint GROUP BY h.card_id"""),
)
def trusted_hints(spark, sf):
    from noonday.operators.catalogue import session_hint

    files = a.files(spark, sf).withColumn("hint", session_hint("path"))
    elsewhere = F.when(F.col("o_orderkey") % 7 == 0, 1_000_000).otherwise(0)
    known = a.read(spark, sf, "orders").select(
        (F.floor(F.col("o_custkey") / 10) + elsewhere).alias("card_id"), F.col("o_orderkey").alias("session_id")
    )
    return m.trusted_hints(files, known)


@query(
    "restrict_to_valid_days",
    with_views(RECORDS, SAMPLES, body="""
SELECT card_id, seq, ts, value FROM samples s WHERE EXISTS (
  SELECT 1 FROM records r WHERE r.card_id = s.card_id AND r.leak_95 IS NOT NULL
    AND CAST(r.date - INTERVAL 12 HOUR AS DATE) = CAST(s.ts - INTERVAL 12 HOUR AS DATE))"""),
    times="ts",
)
def restrict_to_valid_days(spark, sf):
    samples = a.samples(spark, sf).withColumn("clinical_day", clinical_day("ts"))
    days = a.records(spark, sf).where("leak_95 IS NOT NULL").select("card_id", clinical_day("date").alias("clinical_day"))
    return m.restrict_to_days(samples, days, DAY).select("card_id", "seq", "ts", "value")


# Codes of a mode table that depends on the device series.
MODE_CODES = [
    ("A", 1, "CPAP"), ("A", 2, "APAP"), ("A", 3, "APAP"), ("N", 1, "CPAP"), ("N", 2, "APAP"), ("N", 3, "BiPAP"),
    ("R", 1, "CPAP"), ("R", 4, "BiPAP"),
]


@query(
    "lookup_codes",
    "WITH codes AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {c}, '{n}')" for s, c, n in MODE_CODES)
    + ") AS t(series, code, mode))\n"
    "SELECT l_orderkey AS session_id, l_linenumber AS line, l_returnflag AS series, coalesce(mode, '?') AS mode, "
    "count(*) AS n FROM lineitem LEFT JOIN codes ON l_returnflag = series AND l_linenumber = code GROUP BY ALL",
    whole="line",
)
def lookup_codes(spark, sf):
    codes = spark.createDataFrame(MODE_CODES, "series string, code int, mode string")
    # a line is a group of its own: sessions are dealt over tasks first, so that no task groups more when there are more of them
    lines = a.dealt(a.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("code"), F.col("l_returnflag").alias("series")
    )
    labelled = m.lookup_codes(lines, codes, ["series", "code"], "mode")
    return labelled.groupBy(
        "session_id", F.col("code").alias("line"), "series", F.coalesce("mode", F.lit("?")).alias("mode")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pair_files",
    with_views(a.FILES, body="""
, placed AS (
  SELECT card_id, replace(path, '\\', '/') AS path, regexp_replace(replace(path, '\\', '/'), '[^/]*$', '') AS directory FROM files)
SELECT card_id, directory, min(path) FILTER (path LIKE '%.usr') AS summary_path, min(path) FILTER (path LIKE '%.idx') AS minute_path
FROM placed GROUP BY card_id, directory
HAVING min(path) FILTER (path LIKE '%.usr') IS NOT NULL AND min(path) FILTER (path LIKE '%.idx') IS NOT NULL"""),
)
def pair_files(spark, sf):
    from noonday.operators.catalogue import slashes

    files = a.files(spark, sf).withColumn("path", slashes("path"))
    return m.pair_files(files, F.col("path").endswith(".usr"), F.col("path").endswith(".idx"))


@query(
    "active_root_override",
    with_views(a.FILES, body="""
, p AS (
  SELECT card_id, file_id, upper(split_part(path, '/', 2)) AS root, regexp_extract(lower(path), '\\.([^./]*)$', 1) AS ext, path
  FROM files WHERE path LIKE 'P-SERIES/%'),
r AS (
  SELECT card_id, root, count(*) AS files, count(*) FILTER (ext IN ('000', '001', '002')) AS binaries,
    count(*) FILTER (regexp_matches(path, '(?i)(?:^|/)p-series/[^/]+/(?:d|e|u|p[0-9]+)/')) AS data_files, min(file_id) AS first_seen
  FROM p GROUP BY card_id, root),
best AS (
  SELECT card_id, root, count(*) OVER (PARTITION BY card_id) AS n_roots,
    row_number() OVER (PARTITION BY card_id ORDER BY binaries * 10000 + data_files * 100 + files DESC, first_seen, root) AS rn FROM r),
ptr AS (
  SELECT o_custkey // 10 AS card_id, min(o_orderkey) AS seq, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS root
  FROM orders GROUP BY ALL),
named AS (
  SELECT ptr.card_id, arg_min(ptr.root, ptr.seq) AS named FROM ptr JOIN r USING (card_id, root)
  WHERE ptr.seq % 3 = 0 AND (binaries > 0 OR data_files > 0) GROUP BY ptr.card_id)
SELECT b.card_id, b.n_roots, CASE WHEN n_roots = 1 THEN b.root ELSE coalesce(named, b.root) END AS root,
  n_roots > 1 AND named IS NOT NULL AS by_pointer
FROM best b LEFT JOIN named USING (card_id) WHERE rn = 1"""),
)
def active_root_override(spark, sf):
    from noonday.operators.catalogue import root_stats

    roots = root_stats(a.files(spark, sf))
    pointers = a.read(spark, sf, "orders").groupBy(
        F.floor(F.col("o_custkey") / 10).alias("card_id"),
        F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0").alias("root"),
    ).agg(F.min("o_orderkey").alias("seq"))
    # Two thirds of the pointers name a root that no card has.
    pointers = pointers.withColumn("root", F.when(F.col("seq") % 3 == 0, F.col("root")).otherwise(F.concat(F.lit("gone-"), "root")))
    return m.choose_root(roots, pointers)
