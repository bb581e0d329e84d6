"""Views of the test tables in the shape of the domain tables, once in Spark and once as SQL text.

``events`` become samples, sessions and daily records of a card (one card per user); ``orders`` become a file
listing.  Every view is one row per source row and uses the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day, shift_seconds

EPOCH_DAY = "2024-01-01"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    # The tables hold wall-clock time without a zone; the operators use TIMESTAMP under a UTC session clock.
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz})


#: Rows of a table that one task is to hold at most when they are dealt by key.
ROWS_A_TASK = 250_000


def tasks_for(df: DataFrame) -> int:
    """Tasks over which the rows of a table are dealt; the rows are counted in the footers of its files."""
    return -(-df.count() // ROWS_A_TASK)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table dealt over tasks by a key, before texts or paths many times their size are made of them, or before they
    are grouped by that key: a task gets no more of them when the table grows, there are more tasks instead.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks_for(df)), key)


# --- samples ---------------------------------------------------------------------------------------------------

SAMPLES = """
samples AS (
  SELECT user_id AS card_id, event_id AS seq, ts, value, event_type, 120.0::DOUBLE AS sample_seconds
  FROM events)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(read(spark, sf_dir, "events"))


def as_samples(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("card_id"),
        F.col("event_id").alias("seq"),
        "ts",
        "value",
        "event_type",
        F.lit(120.0).alias("sample_seconds"),
    )


# --- sessions --------------------------------------------------------------------------------------------------

SESSIONS = """
raw_sessions AS (
  SELECT user_id AS card_id, event_id AS seq, date_trunc('second', ts) AS start_ts,
         date_trunc('second', ts) + to_seconds(CAST(floor(value * 180) AS BIGINT)) AS end_ts
  FROM events),
sessions AS (
  SELECT * FROM raw_sessions
  WHERE end_ts > start_ts AND epoch(end_ts) - epoch(start_ts) <= 86400)
"""


def raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_trunc("second", "ts")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("card_id"),
        F.col("event_id").alias("seq"),
        start.alias("start_ts"),
        shift_seconds(start, F.floor(F.col("value") * 180)).alias("end_ts"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noonday.operators.cleaning import valid_sessions

    return valid_sessions(raw_sessions(spark, sf_dir))


# --- daily records ---------------------------------------------------------------------------------------------

RECORDS = """
records AS (
  SELECT card_id, seq, ts AS date, kind,
    value / 20 AS usage_hours,
    CASE WHEN kind <> 'signup' THEN k END AS ahi,
    CASE WHEN kind <> 'view' THEN k / 4 END AS residual_apneas,
    k / 8 AS central_apneas,
    k / 16 AS rera_index,
    value * 2 AS leak,
    CASE WHEN kind IN ('click', 'purchase') THEN value * 2.5 END AS leak_95,
    value * 4 AS leak_max,
    value * 3 AS leak_max_30m,
    value * 2.5 AS leak_max_60m,
    CASE WHEN mod(k, 3) <> 0 THEN value * 4 END AS max_leak_duration_value,
    CASE WHEN mod(k, 5) <> 0 THEN mod(k, 7) / 2 END AS max_leak_minutes,
    value * 3.5 AS sustained_leak_max,
    mod(k, 11) AS sustained_leak_minutes,
    4 + mod(k, 20) AS pressure_avg,
    CASE WHEN kind IN ('click', 'error') THEN 6 + mod(k, 20) END AS pressure_95,
    CASE WHEN kind = 'error' THEN 8 + mod(k, 10) END AS ipap_avg,
    CASE WHEN kind = 'error' THEN 9 + mod(k, 12) END AS ipap_95,
    CASE WHEN kind = 'view' THEN 4 + mod(k, 6) END AS epap_avg,
    CASE WHEN kind = 'purchase' THEN 4 + mod(k, 9) END AS epap_95,
    mod(k, 60) / 10 AS vt_avg,
    mod(k, 30) / 20 AS vt_min,
    mod(k, 70) / 10 AS vt_max,
    mod(k, 6) * 10 AS vt_samples,
    mod(k, 40) AS rr_avg,
    mod(k, 15) AS rr_min,
    mod(k, 4) * 5 AS rr_samples,
    'mode:' || CASE mod(card_id + day_index // 9, 3) WHEN 0 THEN 'cpap' WHEN 1 THEN 'apap' ELSE 'bipap' END
      AS settings_signature,
    CASE mod(card_id + day_index // 9, 3) WHEN 0 THEN 'CPAP' WHEN 1 THEN 'APAP' ELSE 'BiPAP' END
      AS settings_label
  FROM (SELECT user_id AS card_id, event_id AS seq, ts, value, event_type AS kind,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
               GREATEST(0, date_diff('day', DATE '2024-01-01', CAST(ts - INTERVAL 12 HOUR AS DATE))) AS day_index
        FROM events))
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind, value = F.col("k"), F.col("kind"), F.col("value")

    def only(kinds: str, col):
        return F.when(kind.isin(*kinds.split()), col)

    base = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("card_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("date"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.greatest(F.lit(0), F.datediff(clinical_day("ts"), F.lit(EPOCH_DAY))).alias("day_index"),
    )
    turn = (F.col("card_id") + F.floor(F.col("day_index") / 9)) % 3
    label = F.when(turn == 0, "CPAP").when(turn == 1, "APAP").otherwise("BiPAP")
    return base.select(
        "card_id", "seq", "date", "kind",
        (value / 20).alias("usage_hours"),
        F.when(kind != "signup", k).alias("ahi"),
        F.when(kind != "view", k / 4).alias("residual_apneas"),
        (k / 8).alias("central_apneas"),
        (k / 16).alias("rera_index"),
        (value * 2).alias("leak"),
        only("click purchase", value * 2.5).alias("leak_95"),
        (value * 4).alias("leak_max"),
        (value * 3).alias("leak_max_30m"),
        (value * 2.5).alias("leak_max_60m"),
        F.when(k % 3 != 0, value * 4).alias("max_leak_duration_value"),
        F.when(k % 5 != 0, k % 7 / 2).alias("max_leak_minutes"),
        (value * 3.5).alias("sustained_leak_max"),
        (k % 11).alias("sustained_leak_minutes"),
        (4 + k % 20).alias("pressure_avg"),
        only("click error", 6 + k % 20).alias("pressure_95"),
        only("error", 8 + k % 10).alias("ipap_avg"),
        only("error", 9 + k % 12).alias("ipap_95"),
        only("view", 4 + k % 6).alias("epap_avg"),
        only("purchase", 4 + k % 9).alias("epap_95"),
        (k % 60 / 10).alias("vt_avg"),
        (k % 30 / 20).alias("vt_min"),
        (k % 70 / 10).alias("vt_max"),
        (k % 6 * 10).alias("vt_samples"),
        (k % 40).alias("rr_avg"),
        (k % 15).alias("rr_min"),
        (k % 4 * 5).alias("rr_samples"),
        F.concat(F.lit("mode:"), F.lower(label)).alias("settings_signature"),
        label.alias("settings_label"),
    )


# --- day settings ----------------------------------------------------------------------------------------------

DAY_SETTINGS = """
day_settings AS (
  SELECT DISTINCT card_id, CAST(date - INTERVAL 12 HOUR AS DATE) AS clinical_day,
         settings_signature AS signature, settings_label AS label
  FROM records)
"""


def day_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        records(spark, sf_dir)
        .select(
            "card_id",
            clinical_day("date").alias("clinical_day"),
            F.col("settings_signature").alias("signature"),
            F.col("settings_label").alias("label"),
        )
        .distinct()
    )


# --- file listing ----------------------------------------------------------------------------------------------

FILES = """
files AS (
  SELECT k AS file_id, c // 10 AS card_id,
    CASE k % 10
      WHEN 0 THEN 'DATALOG/' || ymd || '/' || k || '_PLD.edf'
      WHEN 1 THEN 'DATALOG/' || ymd || '/' || k || '/STR.edf'
      WHEN 2 THEN 'THERAPY/RECORD/' || substr(ymd, 1, 6) || '/' || substr(ymd, 7, 2) || '/'
                  || CASE (k // 10) % 4 WHEN 0 THEN 'STAT' WHEN 1 THEN 'EV' WHEN 2 THEN 'P' ELSE 'W' END
                  || lpad(CAST((k // 10) % 100 AS VARCHAR), 2, '0')
                  || CASE WHEN (k // 10) % 4 >= 2 THEN '_' || k ELSE '' END || '.txt'
      WHEN 3 THEN 'BACKUP/b' || (k // 10) % 20 || '.usr'
      WHEN 4 THEN 'BACKUP/b' || (k // 10) % 20 || '.idx'
      WHEN 5 THEN 'BACKUP/b' || (k // 10) % 20 || '.000'
      WHEN 6 THEN 'SETTINGS/' || k || '/CurrentSettings.json'
      WHEN 7 THEN '.Trashes\\' || k || '.tmp'
      WHEN 8 THEN 'P-SERIES/' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '/p' || k % 8 || '/'
                  || lower(lpad(to_hex(k), 8, '0')) || '.00' || k % 3
      ELSE 'notes\\' || substr(ymd, 1, 4) || '-' || substr(ymd, 5, 2) || '-' || substr(ymd, 7, 2) || '\\' || k || '.csv'
    END AS path,
    CAST(floor(price * 20) AS BIGINT) AS size,
    d AS modified_at
  FROM (SELECT o_orderkey AS k, o_custkey AS c, strftime(o_orderdate, '%Y%m%d') AS ymd,
               o_totalprice AS price, o_orderdate AS d FROM orders))
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = k.cast("string")
    ymd = F.date_format("o_orderdate", "yyyyMMdd")
    tens = F.floor(k / 10)
    two = F.lpad((tens % 100).cast("string"), 2, "0")
    role = F.when(tens % 4 == 0, "STAT").when(tens % 4 == 1, "EV").when(tens % 4 == 2, "P").otherwise("W")
    tail = F.when(tens % 4 >= 2, F.concat(F.lit("_"), name)).otherwise("")
    stem = F.concat(F.lit("BACKUP/b"), (tens % 20).cast("string"))
    kind = k % 10
    path = (
        F.when(kind == 0, F.concat(F.lit("DATALOG/"), ymd, F.lit("/"), name, F.lit("_PLD.edf")))
        .when(kind == 1, F.concat(F.lit("DATALOG/"), ymd, F.lit("/"), name, F.lit("/STR.edf")))
        .when(
            kind == 2,
            F.concat(
                F.lit("THERAPY/RECORD/"), F.substring(ymd, 1, 6), F.lit("/"), F.substring(ymd, 7, 2),
                F.lit("/"), role, two, tail, F.lit(".txt"),
            ),
        )
        .when(kind == 3, F.concat(stem, F.lit(".usr")))
        .when(kind == 4, F.concat(stem, F.lit(".idx")))
        .when(kind == 5, F.concat(stem, F.lit(".000")))
        .when(kind == 6, F.concat(F.lit("SETTINGS/"), name, F.lit("/CurrentSettings.json")))
        .when(kind == 7, F.concat(F.lit(".Trashes\\"), name, F.lit(".tmp")))
        .when(
            kind == 8,
            F.concat(
                F.lit("P-SERIES/"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("/p"),
                (k % 8).cast("string"), F.lit("/"), F.lower(F.lpad(F.hex(k), 8, "0")), F.lit(".00"),
                (k % 3).cast("string"),
            ),
        )
        .otherwise(
            F.concat(F.lit("notes\\"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\\"), name, F.lit(".csv"))
        )
    )
    listing = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderkey")
    return listing.select(
        k.alias("file_id"),
        F.floor(F.col("o_custkey") / 10).alias("card_id"),
        path.alias("path"),
        F.floor(F.col("o_totalprice") * 20).alias("size"),
        F.col("o_orderdate").alias("modified_at"),
    )


def with_views(*views: str, body: str) -> str:
    """SQL text: the named views as common table expressions, then the query (which may add views of its own)."""
    return "WITH " + ",".join(v.strip() for v in views) + "\n" + body.strip()
