"""Queries: roll-ups, weighted means, histograms, rates and other grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day, shift_minutes, shift_seconds
from noonday.functions.numbers import norm_leak_lpm
from noonday.operators import rollup
from noonday.operators.cleaning import LEAK, ranged
from noonday.operators.clock import probe_channels, vote_clock_offset
from noonday.operators.signals import daily_records, summarize_days, summarize_intervals, summarize_sessions
from noonday.plans import adapters as a
from noonday.plans.adapters import RECORDS, SAMPLES, with_views
from noonday.plans.registry import query
from noonday.plans.sql_parts import RECORD_DAYS

DAY = ["card_id", "clinical_day"]


def sample_days(spark, sf):
    return a.samples(spark, sf).withColumn("clinical_day", clinical_day("ts"))


SAMPLE_DAYS = SAMPLES + """,
sample_days AS (SELECT *, CAST(ts - INTERVAL 12 HOUR AS DATE) AS clinical_day FROM samples)"""

_DAY_COLUMNS = (
    [f"{f}_{p}" for f in rollup.SUM_COUNT_FIELDS for p in ("sum", "n")]
    + ["ahi_weighted_sum", "ahi_weight_hours", "ahi_sum", "ahi_n", "vt_sum", "vt_n", "rr_sum", "rr_n",
       "vt_min", "vt_max", "rr_min", "leak_max_30m", "leak_max_60m", "leak_max", "max_leak_minutes",
       "sustained_leak_max", "sustained_leak_minutes", "n_records"]
)
_COUNTS = {f"{f}_n" for f in rollup.SUM_COUNT_FIELDS} | {"ahi_n", "n_records"}


@query(
    "day_rollup",
    with_views(
        *RECORD_DAYS,
        body="SELECT card_id, clinical_day, "
        + ", ".join(c if c in _COUNTS else f"round({c}, 6) AS {c}" for c in _DAY_COLUMNS)
        + " FROM days",
    ),
    days="clinical_day",
)
def day_rollup(spark, sf):
    records = a.records(spark, sf)
    days = rollup.finish_days(rollup.day_parts(records), records)
    return (days.select(*DAY, *_DAY_COLUMNS))


@query(
    "ahi_weighted",
    with_views(*RECORD_DAYS, body="""
SELECT card_id, clinical_day,
  round(CASE WHEN ahi_weight_hours > 0 THEN ahi_weighted_sum / ahi_weight_hours
             WHEN ahi_n > 0 THEN ahi_sum / ahi_n END, 6) AS ahi
FROM day_sums"""),
    days="clinical_day",
)
def ahi_weighted(spark, sf):
    days = a.records(spark, sf).groupBy("card_id", clinical_day("date").alias("clinical_day")).agg(*rollup.ahi_parts())
    return (days.select(*DAY, rollup.ahi_of_day().alias("ahi")))


@query(
    "sample_weighted_mean",
    with_views(*RECORD_DAYS, body="""
SELECT card_id, clinical_day, round(vt_sum / vt_n, 6) AS vt, round(rr_sum / rr_n, 6) AS rr FROM day_sums"""),
    days="clinical_day",
)
def sample_weighted_mean(spark, sf):
    parts = rollup.sample_weighted_parts("vt_avg", "vt_samples", rollup.TIDAL_VOLUME, "vt")
    parts += rollup.sample_weighted_parts("rr_avg", "rr_samples", rollup.RESPIRATORY_RATE, "rr")
    days = a.records(spark, sf).groupBy("card_id", clinical_day("date").alias("clinical_day")).agg(*parts)
    return (
        days.select(*DAY, F.try_divide("vt_sum", "vt_n").alias("vt"), F.try_divide("rr_sum", "rr_n").alias("rr"))
    )


@query(
    "argmax_pair",
    with_views(*RECORD_DAYS, body="""
SELECT card_id, clinical_day, round(leak_max, 6) AS leak, round(top_minutes, 6) AS minutes FROM top_pair"""),
    days="clinical_day",
)
def argmax_pair(spark, sf):
    days = a.records(spark, sf).groupBy("card_id", clinical_day("date").alias("clinical_day")).agg(
        rollup.max_leak_pair("leak_max", "max_leak_minutes").alias("p")
    )
    minutes = F.when(F.col("p.minutes") >= 0, F.col("p.minutes")).alias("minutes")
    return (days.where("p IS NOT NULL").select(*DAY, "p.leak", minutes))


@query(
    "argmax_longest",
    with_views(*RECORD_DAYS, body="""
SELECT card_id, clinical_day, round(sustained_leak_minutes, 6) AS minutes, round(sustained_leak_max, 6) AS leak
FROM run_pair"""),
    days="clinical_day",
)
def argmax_longest(spark, sf):
    days = a.records(spark, sf).groupBy("card_id", clinical_day("date").alias("clinical_day")).agg(
        rollup.longest_leak_pair("sustained_leak_max", "sustained_leak_minutes").alias("p")
    )
    return (days.where("p IS NOT NULL").select(*DAY, "p.minutes", "p.leak"))


@query(
    "histogram",
    with_views(SAMPLE_DAYS, body="""
SELECT card_id, clinical_day, round(value, 3) AS bin, count(*) AS n, sum(sample_seconds) AS seconds
FROM sample_days GROUP BY ALL"""),
    days="clinical_day",
)
def histogram(spark, sf):
    return rollup.histogram(sample_days(spark, sf), DAY)


BINS = SAMPLE_DAYS + """,
bins AS (SELECT card_id, clinical_day, round(value, 0) AS bin, count(*) AS n, sum(sample_seconds) AS seconds
         FROM sample_days GROUP BY ALL)"""


def day_bins(spark, sf):
    coarse = sample_days(spark, sf).withColumn("value", F.round("value", 0))
    return rollup.histogram(coarse, DAY)


@query(
    "histogram_merge",
    with_views(BINS, body="""
SELECT card_id, bin, CAST(sum(n) AS BIGINT) AS n, sum(seconds) AS seconds FROM bins WHERE n > 0 GROUP BY ALL"""),
)
def histogram_merge(spark, sf):
    return rollup.merge_histograms(day_bins(spark, sf), ["card_id"])


@query(
    "histogram_percentile",
    with_views(BINS, body="""
SELECT card_id, round(quantile_cont(bin, 0.5), 6) AS p50, round(quantile_cont(bin, 0.95), 6) AS p95
FROM (SELECT card_id, bin, unnest(range(n)) FROM bins) GROUP BY ALL"""),
)
def histogram_percentile(spark, sf):
    merged = rollup.merge_histograms(day_bins(spark, sf), ["card_id"])
    return (
        merged.groupBy("card_id").agg(
            rollup.histogram_percentile(0.5).alias("p50"), rollup.histogram_percentile(0.95).alias("p95")
        )
    )


@query(
    "histogram_duration",
    with_views(BINS, body="""
SELECT card_id, top AS bin, round(sum(seconds) / 60, 6) AS minutes
FROM bins JOIN (SELECT card_id, max(bin) AS top FROM bins GROUP BY ALL) USING (card_id)
WHERE bin = top GROUP BY ALL"""),
)
def histogram_duration(spark, sf):
    merged = rollup.merge_histograms(day_bins(spark, sf), ["card_id"])
    top = F.max_by(F.struct("bin", (F.col("seconds") / 60).alias("minutes")), "bin")
    return merged.groupBy("card_id").agg(top.alias("t")).select("card_id", "t.bin", "t.minutes")


@query(
    "percentile_exact",
    with_views(SAMPLES, body="""
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
FROM samples GROUP BY ALL"""),
)
def percentile_exact(spark, sf):
    return (
        rollup.exact_percentiles(a.samples(spark, sf), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    )


@query(
    "event_rates",
    with_views(RECORDS, body="""
SELECT card_id, clinical_day, round(hours, 6) AS hours, n_obstructive, n_central, n_hypopnea,
  CASE WHEN hours > 0 AND hours <= 24 AND n_obstructive > 0 AND n_central > 0 AND n_hypopnea > 0
       THEN round((n_obstructive + n_central + n_hypopnea) / hours, 6) END AS ahi,
  CASE WHEN hours > 0 AND hours <= 24 AND n_central > 0 THEN round(n_central / hours, 6) END AS central
FROM (SELECT card_id, CAST(date - INTERVAL 12 HOUR AS DATE) AS clinical_day,
             sum(CASE WHEN usage_hours <= 24 THEN usage_hours END) AS hours,
             count(*) FILTER (kind = 'click') AS n_obstructive, count(*) FILTER (kind = 'view') AS n_central,
             count(*) FILTER (kind = 'error') AS n_hypopnea
      FROM records GROUP BY ALL)"""),
    days="clinical_day",
)
def event_rates(spark, sf):
    def n(code):
        return F.count_if(F.col("kind") == code)

    days = a.records(spark, sf).groupBy("card_id", clinical_day("date").alias("clinical_day")).agg(
        F.sum(F.when(F.col("usage_hours") <= 24, F.col("usage_hours"))).alias("hours"),
        n("click").alias("n_obstructive"), n("view").alias("n_central"), n("error").alias("n_hypopnea"),
    )
    parts = [rollup.none_if_zero(F.col(c)) for c in ("n_obstructive", "n_central", "n_hypopnea")]
    return (
        days.withColumns(
            {
                "ahi": rollup.hourly(rollup.all_or_none(*parts), "hours"),
                "central": rollup.hourly(parts[1], "hours"),
            }
        )
    )


@query(
    "event_count_by_code",
    with_views(SAMPLE_DAYS, body="""
SELECT card_id, clinical_day, nullif(count(*) FILTER (event_type IN ('click', 'error', 'view')), 0) AS n_events,
  nullif(count(*) FILTER (event_type = 'error'), 0) AS n_central
FROM sample_days GROUP BY ALL"""),
    days="clinical_day", nullable="n_events n_central",
)
def event_count_by_code(spark, sf):
    return sample_days(spark, sf).groupBy(*DAY).agg(
        rollup.none_if_zero(F.count_if(F.col("event_type").isin("click", "error", "view"))).alias("n_events"),
        rollup.none_if_zero(F.count_if(F.col("event_type") == "error")).alias("n_central"),
    )


@query(
    "minute_flag_count",
    """
SELECT l_orderkey AS card_id, CAST(sum(CASE WHEN l_discount > 0 THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
  CAST(sum(CASE WHEN l_tax > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taxed, count(*) AS minutes
FROM lineitem GROUP BY ALL""",
)
def minute_flag_count(spark, sf):
    flag = lambda c: F.sum((F.col(c) > 0).cast("int"))
    return a.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("card_id")).agg(
        flag("l_discount").alias("flagged"), flag("l_tax").alias("taxed"), F.count(F.lit(1)).alias("minutes")
    )


@query(
    "bitmask_events",
    """
SELECT l_orderkey AS card_id, CAST(sum(bit_count(l_partkey & 63)) AS BIGINT) AS obstructive,
  CAST(sum(bit_count((l_partkey >> 6) & 63)) AS BIGINT) AS hypopnea,
  CAST(sum(bit_count(l_suppkey & 63)) AS BIGINT) AS flow_limited
FROM lineitem GROUP BY ALL""",
)
def bitmask_events(spark, sf):
    def bits(c, shift=0):
        return F.sum(F.bit_count(F.shiftright(c, shift).bitwiseAND(F.lit(63))))

    return a.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("card_id")).agg(
        bits("l_partkey").alias("obstructive"), bits("l_partkey", 6).alias("hypopnea"),
        bits("l_suppkey").alias("flow_limited"),
    )


@query(
    "session_merge",
    """
SELECT l_orderkey AS session_id, max(l_shipdate) AS last_ts, round(sum(l_quantity), 6) AS usage_seconds,
  CAST(sum(l_suppkey) AS BIGINT) AS n_events, max(l_tax) AS leak_max, count(*) AS chunks
FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1)
GROUP BY ALL""",
    times="last_ts",
)
def session_merge(spark, sf):
    chunks = a.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_suppkey", "l_tax", "l_partkey"
    )
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey")
    first = chunks.groupBy("l_orderkey", "l_linenumber").agg(
        F.min_by(F.struct("l_shipdate", "l_quantity", "l_suppkey", "l_tax"), order).alias("c")
    ).select(F.col("l_orderkey").alias("session_id"), "c.*")
    return (
        first.groupBy("session_id").agg(
            F.max("l_shipdate").alias("last_ts"), F.sum("l_quantity").alias("usage_seconds"),
            F.sum("l_suppkey").alias("n_events"), F.max("l_tax").alias("leak_max"),
            F.count(F.lit(1)).alias("chunks"),
        )
    )


@query(
    "clock_offset_vote",
    with_views(SAMPLES, body="""
, raw AS (
  SELECT card_id, seq,
    (CASE event_type WHEN 'click' THEN 480 WHEN 'view' THEN 480 WHEN 'signup' THEN 480 WHEN 'error' THEN -300
          ELSE 60 END) * 60 + CAST(floor(value) AS BIGINT) * 3 AS off_seconds, ts
  FROM samples),
votes AS (
  SELECT card_id, CAST(floor(off_seconds / 900.0 + 0.5) AS BIGINT) * 15 AS off_minutes
  FROM raw WHERE abs(off_seconds / 60.0 - floor(off_seconds / 900.0 + 0.5) * 15) <= 2
    AND abs(floor(off_seconds / 900.0 + 0.5) * 15) <= 840),
counted AS (
  SELECT card_id, off_minutes, count(*) AS n, sum(count(*)) OVER (PARTITION BY card_id) AS total
  FROM votes GROUP BY card_id, off_minutes),
best AS (
  SELECT * FROM counted
  QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY n DESC, abs(off_minutes), off_minutes) = 1),
chosen AS (
  SELECT c.card_id, CASE WHEN b.n >= greatest(2, ceil(b.total * 0.6)) THEN b.off_minutes ELSE 480 END AS offset_minutes,
    CASE WHEN b.n >= greatest(2, ceil(b.total * 0.6)) THEN b.n ELSE 0 END AS verified
  FROM (SELECT DISTINCT card_id FROM raw) c LEFT JOIN best b USING (card_id))
SELECT card_id, offset_minutes, verified, min(ts + to_minutes(offset_minutes)) AS first_ts
FROM raw JOIN chosen USING (card_id) GROUP BY ALL"""),
    times="first_ts", whole="offset_minutes verified",
)
def clock_offset_vote(spark, sf):
    kind = F.col("event_type")
    base = F.when(kind.isin("click", "view", "signup"), 480).when(kind == "error", -300).otherwise(60)
    ends = a.samples(spark, sf).select(
        "card_id", F.col("ts").alias("end_ts"),
        shift_seconds("ts", base * 60 + F.floor("value") * 3).alias("modified_at"),
    )
    offsets = vote_clock_offset(ends)
    shifted = ends.join(offsets, "card_id").withColumn("first_ts", shift_minutes("end_ts", F.col("offset_minutes")))
    return shifted.groupBy("card_id", "offset_minutes", "verified").agg(F.min("first_ts").alias("first_ts"))


@query(
    "latest_setting",
    """
SELECT card_id, mode, price FROM (
  SELECT o_custkey AS card_id, o_orderpriority AS mode, o_totalprice AS price,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""",
)
def latest_setting(spark, sf):
    rows = a.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("card_id"), F.col("o_orderpriority").alias("mode"),
        F.col("o_totalprice").alias("price"), "o_orderdate", "o_orderkey",
    )
    return rollup.latest_by(rows, ["card_id"], ["o_orderdate", "o_orderkey"], ["mode", "price"])


@query(
    "constant_or_null",
    """
SELECT l_orderkey AS card_id, CASE WHEN min(l_tax) = max(l_tax) THEN min(l_tax) END AS pressure,
  CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS mode
FROM lineitem GROUP BY ALL""",
)
def constant_or_null(spark, sf):
    return a.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("card_id")).agg(
        rollup.constant_or_null("l_tax").alias("pressure"), rollup.constant_or_null("l_returnflag").alias("mode")
    )


@query(
    "probe_channel",
    with_views(SAMPLES, body="""
, placed AS (
  SELECT *, CASE WHEN event_type = 'view' THEN value ELSE 0 END AS primary_channel, value / 2 AS alternate
  FROM samples),
probe AS (
  SELECT card_id, count(*) FILTER (primary_channel <> 0) < greatest(1, floor(count(*) / 100.0)) AS use_alternate
  FROM placed GROUP BY ALL)
SELECT card_id, use_alternate, round(sum(CASE WHEN use_alternate THEN alternate ELSE primary_channel END), 6) AS total,
  count(*) AS n
FROM placed JOIN probe USING (card_id) GROUP BY ALL"""),
)
def probe_channel(spark, sf):
    samples = a.samples(spark, sf).withColumns(
        {
            "primary_channel": F.when(F.col("event_type") == "view", F.col("value")).otherwise(0.0),
            "alternate": F.col("value") / 2,
        }
    )
    chosen = probe_channels(samples, ["card_id"], "primary_channel", "alternate")
    return (
        chosen.groupBy("card_id", "use_alternate").agg(F.sum("chosen").alias("total"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "max_then_sum",
    """
SELECT l_orderkey AS card_id, l_shipdate AS ts, max(l_quantity) AS usage, CAST(sum(l_linenumber) AS BIGINT) AS events
FROM lineitem GROUP BY ALL""",
    times="ts",
)
def max_then_sum(spark, sf):
    return a.read(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("card_id"), F.col("l_shipdate").alias("ts")
    ).agg(F.max("l_quantity").alias("usage"), F.sum("l_linenumber").alias("events"))


@query(
    "day_settings_mix",
    with_views(RECORDS, body="""
, ordered AS (
  SELECT card_id, CAST(date - INTERVAL 12 HOUR AS DATE) AS clinical_day,
    list(CASE WHEN mod(seq, 3) = 0 THEN 'mode:apap' ELSE 'mode:cpap' END ORDER BY seq) AS sigs
  FROM records GROUP BY ALL)
SELECT card_id, clinical_day,
  list_reduce(sigs, lambda acc, s: CASE WHEN acc = s THEN acc
    ELSE 'mixed:' || least(acc, s) || '|' || greatest(acc, s) END) AS signature,
  array_to_string(list_transform(list_distinct_in_order(sigs), lambda s: upper(substr(s, 6))), ' + ') AS label,
  len(list_distinct(sigs)) > 1 AS is_mixed
FROM ordered""".replace(
        "array_to_string(list_transform(list_distinct_in_order(sigs), lambda s: upper(substr(s, 6))), ' + ')",
        "CASE WHEN len(list_distinct(sigs)) = 1 THEN upper(substr(sigs[1], 6)) "
        "ELSE upper(substr(sigs[1], 6)) || ' + ' || CASE WHEN sigs[1] = 'mode:apap' THEN 'CPAP' ELSE 'APAP' END END",
    )),
    days="clinical_day",
)
def day_settings_mix(spark, sf):
    mode = F.when(F.col("seq") % 3 == 0, "apap").otherwise("cpap")
    records = a.records(spark, sf).select(
        "card_id", clinical_day("date").alias("clinical_day"), "seq",
        F.concat(F.lit("mode:"), mode).alias("signature"), F.upper(mode).alias("label"),
    )
    return rollup.mixed_day_settings(records)


@query(
    "wave_summary",
    with_views(SAMPLE_DAYS, body="""
SELECT card_id, clinical_day, count(value) AS n, round(avg(value), 6) AS avg_value,
  round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max_value, min(value) AS min_value
FROM sample_days GROUP BY ALL"""),
    days="clinical_day",
)
def wave_summary(spark, sf):
    # Equal readings are counted before the percentile, so a day of any length carries each value once.
    days = sample_days(spark, sf).groupBy(*DAY, "value").agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k")
    return (
        days.groupBy(*DAY).agg(
            total.alias("n"),
            (F.sum(F.col("value") * F.col("k")) / total).alias("avg_value"),
            F.percentile("value", F.lit(0.95), F.col("k")).alias("p95"),
            F.max("value").alias("max_value"),
            F.min("value").alias("min_value"),
        )
    )


@query(
    "daily_leak_from_samples",
    with_views(RECORDS, body="""
SELECT card_id, CAST(date - INTERVAL 12 HOUR AS DATE) AS clinical_day,
  round(sum(leak * (vt_samples + 1)) / sum(vt_samples + 1), 6) AS leak
FROM records WHERE leak >= 0 AND leak < 500 GROUP BY ALL"""),
    days="clinical_day",
)
def daily_leak_from_samples(spark, sf):
    n = F.col("vt_samples") + 1
    leak = ranged("leak", LEAK)
    days = a.records(spark, sf).groupBy("card_id", clinical_day("date").alias("clinical_day")).agg(
        F.try_divide(F.sum(leak * n), F.sum(F.when(leak.isNotNull(), n))).alias("leak")
    )
    return (days.where("leak IS NOT NULL"))


@query(
    "usage_from_size",
    with_views(SAMPLE_DAYS, body="""
SELECT card_id, clinical_day, count(*) AS n_samples, round(count(*) * 120.0 / 3600, 6) AS usage_hours,
  round(avg(value) FILTER (value > 0 AND value <= 80), 6) AS pressure_avg
FROM sample_days GROUP BY ALL"""),
    days="clinical_day",
)
def usage_from_size(spark, sf):
    pressure = F.when((F.col("value") > 0) & (F.col("value") <= 80), F.col("value"))
    return (
        sample_days(spark, sf).groupBy(*DAY).agg(
            F.count(F.lit(1)).alias("n_samples"), (F.sum("sample_seconds") / 3600).alias("usage_hours"),
            F.avg(pressure).alias("pressure_avg"),
        )
    )


ALIASES = [("leak", 1, "click"), ("leak", 2, "view"), ("pressure", 1, "purchase"), ("pressure", 2, "signup"),
           ("pressure", 3, "error")]


@query(
    "pivot_daily_signals",
    with_views(SAMPLES, body="""
, files AS (SELECT card_id, min(ts) AS start_ts FROM samples GROUP BY card_id),
picked AS (
  SELECT s.card_id, CAST(ts AS DATE) AS day, metric, prio, avg(CASE WHEN signal = 'click' THEN value * 60 ELSE value END) AS v
  FROM samples s JOIN (VALUES ('leak', 1, 'click'), ('leak', 2, 'view'), ('pressure', 1, 'purchase'),
    ('pressure', 2, 'signup'), ('pressure', 3, 'error')) AS al(metric, prio, signal) ON s.event_type = al.signal
  GROUP BY ALL),
best AS (SELECT * FROM picked QUALIFY row_number() OVER (PARTITION BY card_id, day, metric ORDER BY prio) = 1),
wide AS (SELECT card_id, day, max(v) FILTER (metric = 'leak') AS leak, max(v) FILTER (metric = 'pressure') AS pressure FROM best GROUP BY ALL),
latest AS (SELECT card_id, arg_max(pressure, day) FILTER (pressure IS NOT NULL) AS latest_pressure FROM wide GROUP BY card_id)
SELECT w.card_id, w.day, round(round(CASE WHEN leak < 500 THEN leak END, 9), 6) AS leak, round(round(CASE WHEN pressure > 0 AND pressure <= 80 THEN pressure END, 9), 6) AS pressure,
  CAST(f.start_ts - INTERVAL 12 HOUR AS DATE) AS history_start, round(round(latest_pressure, 9), 6) AS latest_pressure
FROM wide w JOIN files f ON f.card_id = w.card_id JOIN latest l ON l.card_id = w.card_id"""),
    days="day history_start",
)
def pivot_daily_signals(spark, sf):
    """A summary file per card: a data record per day, two channels for the leak, one of them in litres a second."""
    # nearly every sample is a group of its own: each card is dealt to one task, so that no task groups more when there are more cards
    samples = a.as_samples(a.dealt(a.read(spark, sf, "events"), "user_id"))
    daily = samples.groupBy("card_id", F.to_date("ts").alias("day"), F.col("event_type").alias("channel")).agg(
        F.avg("value").alias("value"), F.min("ts").alias("first_ts")
    )
    signals = daily.withColumn("start_ts", F.min("first_ts").over(Window.partitionBy("card_id"))).select(
        "card_id", "start_ts", F.datediff("day", F.to_date("start_ts")).alias("seq"), "channel", "value",
        F.when(F.col("channel") == "click", "L/s").otherwise("L/min").alias("unit"),
    )
    units = {"leak": lambda v, unit: norm_leak_lpm(v, unit)}
    found = daily_records(signals, ALIASES, units, ["pressure"])
    steady = lambda c: F.round(c, 9)
    return found.select(
        "card_id", F.col("date").alias("day"), steady(ranged("leak", LEAK)).alias("leak"), steady(ranged("pressure", rollup.PRESSURE)).alias("pressure"),
        "history_start", steady(F.col("latest_pressure")).alias("latest_pressure"),
    )


SESSION_SAMPLES = SAMPLES + """,
blocks AS (SELECT *, date_trunc('week', ts) AS session_start FROM samples)"""


@query(
    "session_from_samples",
    with_views(SESSION_SAMPLES, body="""
, flagged AS (
  SELECT *, value > 30 AS above, row_number() OVER w AS rn,
    row_number() OVER (PARTITION BY card_id, session_start, value > 30 ORDER BY ts, seq) AS rk
  FROM blocks WINDOW w AS (PARTITION BY card_id, session_start ORDER BY ts, seq)),
runs AS (
  SELECT card_id, session_start, rn - rk AS isl, count(*) * 2.0::DOUBLE AS minutes, max(value) AS peak
  FROM flagged WHERE above GROUP BY ALL),
best AS (
  SELECT card_id, session_start, max(minutes) AS longest_minutes, arg_max(peak, minutes * 100000 + peak) AS longest_leak,
    max(peak) AS max_leak
  FROM runs GROUP BY ALL)
SELECT b.card_id, b.session_start, max(ts) + INTERVAL 2 MINUTE AS session_end, count(*) AS n_samples,
  round(avg(value), 6) AS leak, round(quantile_cont(round(value, 3), 0.5), 6) AS median,
  round(round(avg(value / 25) FILTER (value > 0 AND value / 25 <= 5), 9), 6) AS vt_avg, round(min(value / 25) FILTER (value > 0 AND value / 25 <= 5), 6) AS vt_min,
  round(max(value / 25) FILTER (value > 0 AND value / 25 <= 5), 6) AS vt_max,
  round(quantile_cont(round(value / 25, 3), 0.5) FILTER (value > 0 AND value / 25 <= 5), 6) AS vt_p50, count(*) FILTER (value > 0 AND value / 25 <= 5) AS vt_samples,
  round(round(avg(value) FILTER (event_type <> 'view' AND value > 0 AND value <= 120), 9), 6) AS rr_avg, min(value) FILTER (event_type <> 'view' AND value > 0 AND value <= 120) AS rr_min,
  round(quantile_cont(round(value, 3), 0.95) FILTER (event_type <> 'view' AND value > 0 AND value <= 120), 6) AS rr_p95,
  any_value(r.longest_minutes) AS longest_minutes, any_value(r.longest_leak) AS longest_leak, any_value(r.max_leak) AS max_leak
FROM blocks b LEFT JOIN best r USING (card_id, session_start) GROUP BY ALL"""),
    times="session_start session_end",
)
def session_from_samples(spark, sf):
    blocks = a.samples(spark, sf).withColumn("session_start", F.date_trunc("week", "ts"))
    channels = {
        "vt": (F.col("value") / 25, rollup.TIDAL_VOLUME, 0.5),
        "rr": (F.when(F.col("event_type") != "view", F.col("value")), rollup.RESPIRATORY_RATE, 0.95),
    }
    out = summarize_sessions(blocks, ["card_id", "session_start"], ["ts", "seq"], channels=channels)
    return out.withColumns({c: F.round(c, 9) for c in ("vt_avg", "rr_avg")}).select(
        "card_id", "session_start", "session_end", "n_samples", "leak", "median", "vt_avg", "vt_min", "vt_max", "vt_p50", "vt_samples",
        "rr_avg", "rr_min", "rr_p95", "longest_minutes", "longest_leak", "max_leak",
    )


_DAY_SAMPLES_SQL = """
, placed AS (
  SELECT *, lag(ts) OVER (PARTITION BY card_id ORDER BY ts, seq) AS prev_ts,
    row_number() OVER (PARTITION BY card_id ORDER BY ts, seq) AS rn
  FROM sample_days),
marked AS (
  SELECT *, max(CASE WHEN prev_ts IS NULL OR epoch_us(ts) - epoch_us(prev_ts) > 12 * 3600 * 1000000::BIGINT THEN rn END)
    OVER (PARTITION BY card_id ORDER BY rn) AS island FROM placed),
rolled AS (
  SELECT *, CASE WHEN rn - island + 1 >= 3 THEN avg(value) OVER (PARTITION BY card_id, island ORDER BY rn
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS roll FROM marked),
flagged AS (
  SELECT *, value > 30 AND NOT coalesce(lag(value) OVER w > 30, false) OR
    (value > 30 AND epoch_us(ts) - epoch_us(prev_ts) > 12 * 3600 * 1000000::BIGINT) AS opens
  FROM marked WINDOW w AS (PARTITION BY card_id, clinical_day ORDER BY rn)),
runs AS (
  SELECT card_id, clinical_day, run, count(*) * 2.0::DOUBLE AS minutes, max(value) AS peak
  FROM (SELECT *, max(CASE WHEN opens THEN rn END) OVER (PARTITION BY card_id, clinical_day ORDER BY rn) AS run
        FROM flagged) WHERE value > 30 GROUP BY ALL),
best AS (
  SELECT card_id, clinical_day, max(minutes) AS longest_minutes,
    arg_max(peak, minutes * 100000 + peak) AS longest_leak, max(peak) AS top_leak,
    arg_max(minutes, peak * 100000 + minutes) AS top_minutes
  FROM runs GROUP BY ALL)
SELECT s.card_id, s.clinical_day, count(*) AS n, round(avg(value), 6) AS mean_leak, max(value) AS max_leak,
  round(max(roll), 6) AS roll_max, round(quantile_cont(value, 0.95), 6) AS p95,
  any_value(longest_minutes) AS longest_minutes, any_value(longest_leak) AS longest_leak,
  any_value(top_leak) AS top_leak, any_value(top_minutes) AS top_minutes
FROM rolled s LEFT JOIN best USING (card_id, clinical_day) GROUP BY ALL"""


@query("day_from_samples", with_views(SAMPLE_DAYS, body=_DAY_SAMPLES_SQL), days="clinical_day")
def day_from_samples(spark, sf):
    return (
        summarize_days(
            sample_days(spark, sf), ["clinical_day"], ["ts", "seq"], {"roll_max": 3}, max_step_seconds=12 * 3600.0
        )
    )


@query(
    "interval_sample_summary",
    with_views(SESSION_SAMPLES, body="""
, placed AS (
  SELECT *, row_number() OVER (PARTITION BY card_id, session_start ORDER BY ts, seq) AS rn FROM blocks),
rolled AS (
  SELECT *, CASE WHEN rn >= 5 THEN avg(value) OVER (PARTITION BY card_id, session_start ORDER BY rn
    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS roll FROM placed),
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY card_id, session_start, value > 30 ORDER BY ts, seq) AS rk FROM placed),
runs AS (SELECT card_id, session_start, rn - rk AS isl, count(*) * 2.0::DOUBLE AS minutes, max(value) AS peak FROM flagged WHERE value > 30 GROUP BY ALL),
best AS (
  SELECT card_id, session_start, max(minutes) AS longest_minutes, arg_max(peak, minutes * 100000 + peak) AS longest_leak,
    arg_max(minutes, peak * 100000 + minutes) AS top_minutes FROM runs GROUP BY ALL)
SELECT card_id, session_start, any_value(longest_minutes) AS longest_minutes, any_value(longest_leak) AS longest_leak, any_value(top_minutes) AS top_minutes,
  round(round(avg(value % 20 + 4), 9), 6) AS pressure_avg, round(quantile_cont(round(value % 20 + 4, 3), 0.95), 6) AS pressure_p95,
  count(*) AS n, round(count(*) * 2.0 / 60, 6) AS usage_hours,
  session_start + to_minutes(CAST(2 * count(*) AS BIGINT)) AS session_end,
  round(avg(value), 6) AS mean_leak, max(value) AS max_leak, round(max(roll), 6) AS roll_max,
  round(count(*) FILTER (event_type = 'error') / (count(*) * 2.0 / 60), 6) AS error_rate
FROM rolled LEFT JOIN best USING (card_id, session_start) GROUP BY card_id, session_start"""),
    times="session_start session_end",
)
def interval_sample_summary(spark, sf):
    blocks = a.samples(spark, sf).withColumn("session_start", F.date_trunc("week", "ts"))
    with_pressure = blocks.withColumn("pressure", F.col("value") % 20 + 4)
    return summarize_intervals(with_pressure, ["ts", "seq"], {"roll_max": 5}).withColumn("pressure_avg", F.round("pressure_avg", 9))


@query(
    "leak_outer_merge",
    with_views(*RECORD_DAYS, SAMPLE_DAYS, body="""
, s AS (
  SELECT card_id, clinical_day + CAST(card_id % 2 AS INTEGER) AS clinical_day, avg(value) AS mean_leak, max(value) * 4 AS max_leak,
    min(value) AS max_leak_minutes, max(value) * 3 AS max_30m, NULL::DOUBLE AS max_60m, max(value) AS longest_leak,
    count(*) * 2.0 AS longest_minutes
  FROM sample_days GROUP BY ALL),
m AS (
  SELECT coalesce(d.card_id, s.card_id) AS card_id, coalesce(d.clinical_day, s.clinical_day) AS clinical_day,
    coalesce(leak_sum, 0) + CASE WHEN s.mean_leak IS NOT NULL AND coalesce(leak_n, 0) = 0 THEN s.mean_leak ELSE 0 END AS leak_sum,
    coalesce(leak_n, 0) + CASE WHEN s.mean_leak IS NOT NULL AND coalesce(leak_n, 0) = 0 THEN 1 ELSE 0 END AS leak_n,
    d.leak_max AS dl, d.max_leak_minutes AS dm, s.max_leak AS sl, s.max_leak_minutes AS sm,
    leak_max_30m, max_30m, leak_max_60m, sustained_leak_minutes AS drm, sustained_leak_max AS drl,
    longest_minutes AS srm, longest_leak AS srl
  FROM days d FULL OUTER JOIN s ON d.card_id = s.card_id AND d.clinical_day = s.clinical_day)
SELECT card_id, clinical_day, round(leak_sum, 6) AS leak_sum, CAST(leak_n AS BIGINT) AS leak_n,
  round(greatest(dl, sl), 6) AS leak_max,
  round(CASE WHEN sl IS NULL OR dl > sl THEN dm WHEN dl IS NULL OR sl > dl THEN sm ELSE greatest(dm, sm) END, 6) AS max_leak_minutes,
  round(greatest(leak_max_30m, max_30m), 6) AS leak_max_30m, round(leak_max_60m, 6) AS leak_max_60m,
  round(CASE WHEN srm IS NULL OR drm > srm THEN drl WHEN drm IS NULL OR srm > drm THEN srl ELSE greatest(drl, srl) END, 6) AS sustained_leak_max,
  round(greatest(drm, srm), 6) AS sustained_leak_minutes
FROM m"""),
    days="clinical_day",
)
def leak_outer_merge(spark, sf):
    records = a.records(spark, sf)
    days = rollup.finish_days(rollup.day_parts(records), records)
    leaks = (
        sample_days(spark, sf)
        .groupBy("card_id", "clinical_day").agg(
            F.avg("value").alias("mean_leak"), (F.max("value") * 4).alias("max_leak"),
            F.min("value").alias("max_leak_minutes"), (F.max("value") * 3).alias("max_30m"),
            F.lit(None).cast("double").alias("max_60m"), F.max("value").alias("longest_leak"),
            (F.count(F.lit(1)) * 2.0).alias("longest_minutes"),
        )
        .withColumn("clinical_day", F.date_add("clinical_day", (F.col("card_id") % 2).cast("int")))
    )
    return (rollup.merge_sample_leak(days, leaks, keep_summary_leak=True))


@query(
    "approx_equal_match",
    with_views(*RECORD_DAYS, body="SELECT card_id, clinical_day, matched_minutes FROM near_pair"),
    days="clinical_day",
)
def approx_equal_match(spark, sf):
    records = a.records(spark, sf)
    return rollup.approx_equal_minutes(records, rollup.day_parts(records))


@query(
    "day_merge_batches",
    with_views(
        *RECORD_DAYS,
        body="SELECT card_id, clinical_day, n_records, usage_hours_n, round(usage_hours_sum, 6) AS usage_hours_sum, "
        "round(ahi_weighted_sum, 6) AS ahi_weighted_sum, round(leak_max_30m, 6) AS leak_max_30m FROM day_sums",
    ),
    days="clinical_day",
)
def day_merge_batches(spark, sf):
    """Two batches rolled up on their own and merged give the roll-up of both."""
    records = a.records(spark, sf)
    parts = rollup.day_parts(records.where("kind IN ('view', 'click')")).unionByName(
        rollup.day_parts(records.where("kind NOT IN ('view', 'click')"))
    )
    return (
        rollup.merge_day_parts(parts).select(
            *DAY, "n_records", "usage_hours_n", "usage_hours_sum", "ahi_weighted_sum", "leak_max_30m"
        )
    )
