"""Queries: text extraction and scalar functions.

Texts are composed from table columns and taken apart again, so SQL on the columns tells the expected result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from noonday.functions import dates, modes, numbers, settings
from noonday.plans import adapters as a
from noonday.plans.registry import query
from noonday.sources import text as t

K = ["file_id"]


def orders(spark, sf):
    return a.dealt(a.read(spark, sf, "orders"), "o_orderkey").withColumns({"file_id": F.col("o_orderkey"), "k": F.col("o_orderkey")})


def s(c):
    """Number as text."""
    return c.cast("string")


def kv_files(spark, sf):
    """Key-value text of an order: both separators, CRLF, a NUL, an inline blob, sometimes a repeated key."""
    k = F.col("k")
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    text = F.concat(
        F.lit("Device: Model "), s(k % 5), F.lit("\r\n usageHours="), s(k % 30), F.lit("\n"),
        F.lit("cntOAI: "), s(k % 7), nul, F.lit("cntHI = "), s(k % 11), F.lit("\nnote a=b: c\n"),
        F.lit("blob,rr=12;Press="), s(k % 1000), F.lit("\nmax leak rate\nMaxLeak="), s(k % 700), F.lit("\navgLeak: "), s(k % 90),
        F.lit("\nutcOffset: "), F.when(k % 3 == 0, F.concat(F.lit("+0"), s(k % 9), F.lit(":30"))).otherwise(""),
        F.when(k % 3 == 0, F.concat(F.lit("\nusageHours: "), s(k % 20))).otherwise(""),
    )
    return orders(spark, sf).select("file_id", "k", text.alias("text"))


_BASE = "FROM (SELECT o_orderkey AS file_id, o_orderkey AS k, * FROM orders)"
_USAGE = "CASE WHEN k % 3 = 0 THEN k % 20 ELSE k % 30 END"


@query(
    "parse_kv",
    f"""
SELECT file_id, 'Device' AS key, 'Model ' || k % 5 AS value {_BASE}
UNION ALL SELECT file_id, 'usageHours', CAST({_USAGE} AS VARCHAR) {_BASE}
UNION ALL SELECT file_id, 'cntOAI', CAST(k % 7 AS VARCHAR) {_BASE}
UNION ALL SELECT file_id, 'cntHI', CAST(k % 11 AS VARCHAR) {_BASE}
UNION ALL SELECT file_id, 'note a', 'b: c' {_BASE}
UNION ALL SELECT file_id, 'blob,rr', '12;Press=' || k % 1000 {_BASE}
UNION ALL SELECT file_id, 'rr', '12' {_BASE}
UNION ALL SELECT file_id, 'Press', CAST(k % 1000 AS VARCHAR) {_BASE}
UNION ALL SELECT file_id, 'MaxLeak', CAST(k % 700 AS VARCHAR) {_BASE}
UNION ALL SELECT file_id, 'avgLeak', CAST(k % 90 AS VARCHAR) {_BASE}
UNION ALL SELECT file_id, 'utcOffset', CASE WHEN k % 3 = 0 THEN '+0' || k % 9 || ':30' ELSE '' END {_BASE}""",
)
def parse_kv(spark, sf):
    return t.key_values(kv_files(spark, sf), K).select("file_id", "key", "value")


def _maps(spark, sf):
    return t.value_maps(t.key_values(kv_files(spark, sf), K), K)


@query(
    "parse_daily_kv",
    f"""
SELECT file_id, CASE WHEN h <= 24 THEN h END AS usage_hours,
  CASE WHEN h > 0 THEN round((k % 7 + k % 11) / h, 6) END AS ahi,
  CAST(k % 90 AS DOUBLE) AS leak, CASE WHEN k % 700 < 500 THEN CAST(k % 700 AS DOUBLE) END AS leak_max,
  'pressure:' || p || ' cmh2o' AS settings_signature, 'Therapy ' || p || ' cmH2O' AS settings_label, 'Fixed ' || p || ' cmH2O' AS pressure
FROM (SELECT *, CAST({_USAGE} AS DOUBLE) AS h,
  regexp_replace(printf('%.2f', CASE WHEN k % 1000 <= 80 THEN k % 1000 ELSE (k % 1000) / 100 END::DOUBLE), '\\.?0+$', '') AS p {_BASE})
WHERE true""",
)
def parse_daily_kv(spark, sf):
    found = t.daily_records(_maps(spark, sf))
    return found.select("file_id", "usage_hours", "ahi", "leak", "leak_max", "settings_signature", "settings_label", F.col("settings_machine.pressure").alias("pressure"))


@query(
    "parse_counter_kv",
    """
SELECT file_id, round(u / 3600.0::DOUBLE, 6) AS usage_hours, CASE WHEN u > 0 AND k % 4 <> 0 THEN round((k % 9 + k % 5) / (u / 3600.0::DOUBLE), 6) END AS ahi,
  CASE WHEN u > 0 THEN round(k % 9 / (u / 3600.0::DOUBLE), 6) END AS residual_apneas, k % 60 + 0.5::DOUBLE AS leak,
  CASE WHEN k % 600 < 500 THEN k % 600 + 0.0::DOUBLE END AS leak_95,
  CASE WHEN k % 2 = 0 THEN 'mode:apap|pressureMax:' || (k % 9 + 8) || ' cmh2o|pressureMin:4 cmh2o' END AS settings_signature,
  CASE WHEN k % 2 = 0 THEN 'APAP 4 cmH2O-' || (k % 9 + 8) || ' cmH2O' END AS settings_label
FROM (SELECT o_orderkey AS file_id, o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey % 24) * 3600 END AS u FROM orders)""",
)
def parse_counter_kv(spark, sf):
    k = F.col("k")
    text = F.concat(
        F.lit("secUsed="), F.when(k % 6 == 0, "90000").otherwise(s((k % 24) * 3600)), F.lit("\ncntAI="), s(k % 9),
        F.when(k % 4 != 0, F.concat(F.lit("\ncntHI="), s(k % 5))).otherwise(""), F.lit("\nmedLeak="), s(k % 60), F.lit(".5"),
        F.lit("\np95Leak="), s(k % 600), F.when(k % 2 == 0, F.concat(F.lit("\nmode: APAP\nPMin=4\nPMax="), s(k % 9 + 8))).otherwise(""),
    )
    files = orders(spark, sf).select("file_id", text.alias("text"))
    maps = t.value_maps(t.key_values(files, K), K)
    return t.counter_records(maps).select("file_id", "usage_hours", "ahi", "residual_apneas", "leak", "leak_95", "settings_signature", "settings_label")


def table_text(second=True):
    """A daily table of two rows, or of the first alone where ``second`` does not hold, and a row without a date."""
    k = F.col("k")
    tab = F.when(k % 2 == 0, F.lit("\t")).otherwise(F.lit(","))

    def row(i: int):
        day = F.date_format(F.date_add(F.to_date("o_orderdate"), i), "yyyy-MM-dd")
        return F.concat_ws(
            tab_marker, s((k + i) % 13), F.when(k % 5 == 0, F.date_format(F.date_add(F.to_date("o_orderdate"), i), "MM/dd/yyyy")).otherwise(day),
            F.concat(s((k + i) % 24), F.lit(".25")), s((k * (i + 1)) % 80), s((k + i) % 120), F.lit("APAP"), s(k % 15 + 4),
        )

    tab_marker = "\u0001"
    head = F.lit("AHI\u0001Clinical Day\u0001Usage Hours\u0001Leak\u0001Max Leak\u0001Mode\u0001Min-Pressure")
    bad = F.concat_ws(tab_marker, F.lit("1"), F.lit("n/a"), F.lit("2"), F.lit("3"), F.lit("4"), F.lit("CPAP"), F.lit("5"))
    return F.replace(F.concat_ws("\n", head, row(0), bad, F.lit(""), F.when(F.lit(second) if isinstance(second, bool) else second, row(1))), F.lit(tab_marker), tab)


_TABLE_ROWS = """
rows AS (
  SELECT o_orderkey AS file_id, o_orderkey AS k, i, CAST(o_orderdate AS DATE) + i AS day FROM orders, (VALUES (0), (1)) AS v(i))"""


@query(
    "parse_delimited",
    f"""WITH {_TABLE_ROWS.strip()}
SELECT file_id, CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR AS date, (k + i) % 24 + 0.25::DOUBLE AS usage_hours, CAST((k + i) % 13 AS DOUBLE) AS ahi,
  CAST((k * (i + 1)) % 80 AS DOUBLE) AS leak, CAST((k + i) % 120 AS DOUBLE) AS leak_max, 'mode=APAP;min-pressure=' || (k % 15 + 4) AS settings
FROM rows""",
    times="date",
)
def parse_delimited(spark, sf):
    files = orders(spark, sf).select("file_id", table_text().alias("text"))
    texts = F.array_join(F.transform("settings", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return t.table_records(files, K).select("file_id", "date", "usage_hours", "ahi", "leak", "leak_max", texts.alias("settings"))


def line_text():
    k = F.col("k")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return F.concat(
        F.lit("Report\n"), day, F.lit(" 07:05 Usage: "), s(k % 12), F.lit(".5 h, AHI = "), s(k % 40), F.lit(", leak "), s(k % 99),
        F.lit("; mean pressure "), s(k % 20 + 4), F.lit("\nno date here, AHI 3\n"), F.date_format("o_orderdate", "MM/dd/yyyy"),
        F.lit(" central index "), s(k % 6), F.lit(" max leak "), s(k % 50),
    )


_LINE_ROWS = """
SELECT o_orderkey AS file_id, o_orderdate + INTERVAL 425 MINUTE AS date, o_orderkey % 12 + 0.5::DOUBLE AS usage_hours,
  CAST(o_orderkey % 40 AS DOUBLE) AS ahi, CAST(o_orderkey % 99 AS DOUBLE) AS leak, NULL::DOUBLE AS leak_max, CAST(o_orderkey % 20 + 4 AS DOUBLE) AS pressure_avg FROM orders
UNION ALL
SELECT o_orderkey, o_orderdate + INTERVAL 12 HOUR, NULL, NULL, CAST(o_orderkey % 50 AS DOUBLE), CAST(o_orderkey % 50 AS DOUBLE), NULL FROM orders"""


@query("parse_freetext", _LINE_ROWS.strip(), times="date")
def parse_freetext(spark, sf):
    files = orders(spark, sf).select("file_id", line_text().alias("text"))
    return t.line_records(files, K).select("file_id", "date", "usage_hours", "ahi", "leak", "leak_max", "pressure_avg")


@query(
    "parse_fallback",
    f"""WITH {_TABLE_ROWS.strip()}
SELECT file_id, CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR AS date, CAST((k + i) % 13 AS DOUBLE) AS ahi, CAST((k * (i + 1)) % 80 AS DOUBLE) AS leak
FROM rows WHERE k % 3 <> 0
UNION ALL SELECT file_id, date, ahi, leak FROM ({_LINE_ROWS.strip()}) WHERE file_id % 3 = 0""",
    times="date",
)
def parse_fallback(spark, sf):
    text = F.when(F.col("k") % 3 == 0, line_text()).otherwise(table_text())
    files = orders(spark, sf).select("file_id", text.alias("text"))
    return t.any_records(files, K).select("file_id", "date", "ahi", "leak")


# Readings of UTF-8 texts without NUL: UTF-8, the same behind a header of four bytes (bytes that continue a cut character are
# replaced), Latin-1, and printable ASCII of the Latin-1 reading without and with the header skipped.
@query(
    "decode_text",
    """
WITH t AS (
  SELECT doc_id, text, hex(encode(text)) AS h, least(coalesce(list_position(list_transform(range(1, 5), lambda j: strlen(left(text, j)) >= 4), true), 4), length(text)) AS j
  FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT doc_id, text, list_aggregate(list_transform(regexp_extract_all(h, '..'), lambda x: chr(CAST('0x' || x AS INTEGER))), 'string_agg', '') AS latin,
    repeat(chr(65533), greatest(0, strlen(left(text, j)) - 4)::BIGINT) || substr(text, j + 1) AS tail FROM t),
r AS (
  SELECT doc_id, [text, tail, latin, regexp_replace(latin, '[^\\x20-\\x7E\\t\\n\\r]', chr(10), 'g'), regexp_replace(substr(latin, 5), '[^\\x20-\\x7E\\t\\n\\r]', chr(10), 'g')] AS texts FROM b),
s AS (SELECT doc_id, list_filter(list_transform(texts, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) AS texts FROM r),
u AS (SELECT doc_id, list_filter(texts, lambda x, i: list_position(texts, x) = i) AS texts FROM s)
SELECT doc_id, i - 1 AS variant, length(texts[i]) AS n_chars, md5(texts[i]) AS digest FROM (SELECT doc_id, texts, unnest(range(1, len(texts) + 1)) AS i FROM u)""",
)
def decode_text(spark, sf):
    """All readings of every document, by digest."""
    docs = a.read(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    read = t.decode_variants(docs)
    return read.select("doc_id", "variant", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("best_variant", "SELECT o_orderkey AS file_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n_records FROM orders")
def best_variant(spark, sf):
    text = table_text(F.col("k") % 3 > 0)
    content = F.when(F.col("k") % 2 == 0, F.encode(text, "UTF-16LE")).otherwise(F.encode(text, "UTF-8"))
    files = orders(spark, sf).select("file_id", content.alias("content"))
    readings = t.decode_variants(files)
    records = t.any_records(readings, ["file_id", "variant"]).distinct()
    counts = records.groupBy("file_id", "variant").agg(F.count(F.lit(1)).alias("n_records"))
    return t.best_variant(counts, K).select("file_id", "n_records")


JSON_SETTINGS = """
SELECT file_id, CASE WHEN p = 0 THEN 'CPAP' WHEN p = 1 THEN 'APAP' ELSE 'BiPAP' END AS mode,
  CASE WHEN p = 0 THEN 'Fixed ' || (k % 20 + 4) || ' cmH2O' END AS pressure,
  CASE WHEN p = 1 THEN (k % 9 + 4) || '.5 cmH2O' END AS pressure_min,
  CASE WHEN p = 2 THEN (k % 6 + 4) || ' cmH2O' END AS epap, CASE WHEN p = 2 THEN (k % 8 + 10) || ' cmH2O' END AS ipap,
  CASE WHEN p <> 2 THEN 'EPR: On ' || (k % 3 + 1) || ' (full time)' ELSE 'PS: ' || (k % 4 + 2) || ' cmH2O' END AS pressure_relief,
  CASE WHEN p = 1 THEN '20 cmH2O' END AS pressure_max, p = 1 AS pressure_auto,
  CASE WHEN p = 2 THEN (k % 15 + 8) || ' bpm' END AS respiratory_rate, CASE WHEN p = 2 THEN (k % 400 + 200) || ' mL' END AS tidal_volume,
  CASE WHEN p = 2 AND k % 4 <> 0 THEN (k % 3 + 4) || ' cmH2O' END AS ramp_pressure,
  CASE WHEN k % 4 = 0 THEN 'Off' WHEN k % 45 = 1 THEN '1 minute' WHEN k % 45 = 0 THEN 'Off' ELSE k % 45 || ' minutes' END AS ramp_time,
  CAST((k % 12) * 60 + 30 AS BIGINT) AS offset_minutes
FROM (SELECT o_orderkey AS file_id, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 3 END AS p FROM orders)"""


@query("parse_settings_json", JSON_SETTINGS)
def parse_settings_json(spark, sf):
    return json_settings_of(spark, sf)


def json_settings_of(spark, sf):
    return t.json_settings(json_texts(spark, sf), K)


def json_texts(spark, sf):
    """Active profile by name; every seventh file names one that does not exist, so the first with a mode is used."""
    k = F.col("k")

    def obj(*pairs):
        parts = []
        for name, value in pairs:
            parts += [F.lit(f'"{name}":') if isinstance(name, str) else F.concat(text(name), F.lit(":")), value if not isinstance(value, str) else F.lit(value), F.lit(",")]
        return F.concat(F.lit("{"), *parts[:-1], F.lit("}"))

    def text(c):
        return F.concat(F.lit('"'), c, F.lit('"'))

    active = F.when(k % 7 == 0, "Gone").when(k % 3 == 0, "Fixed").when(k % 3 == 1, "Auto").otherwise("Level")
    profiles = obj(
        ("Empty", '{"SetPressure":1}'),
        ("Fixed", obj(("TherapyMode", '"CPAP"'), ("SetPressure", s(k % 20 + 4)))),
        ("Auto", obj(("TherapyMode", '"AutoSet"'), ("MinPressure", F.concat(s(k % 9 + 4), F.lit(".50"))), ("MaxPressure", "20"))),
        ("Level", obj(
            ("TherapyMode", '"BiLevel"'), (F.when(k % 2 == 0, "Epap").otherwise("EPAP"), s(k % 6 + 4)), (F.when(k % 2 == 0, "Ipap").otherwise("IPAP"), s(k % 8 + 10)),
            ("Ps", s(k % 4 + 2)), ("RR", s(k % 15 + 8)), (F.when(k % 2 == 0, "TargetVT").otherwise("TidalVolumeTarget"), s(k % 400 + 200)),
            ("StartPress", s(k % 3 + 4)),
        )),
    )
    features = obj(
        ("TimeZoneFeature", obj(("TimeZoneOffset", text(F.concat(F.lit("+"), F.lpad(s(k % 12), 2, "0"), F.lit(":30")))))),
        ("AutoRampFeature", obj(("RampEnable", F.when(k % 4 == 0, '"Off"').otherwise('"On"')), ("RampTime", s(k % 45)))),
        ("EprFeature", obj(("EprEnable", '"On"'), ("EprPressure", s(k % 3 + 1)), ("EprType", '"FullTime"'))),
    )
    body = obj(("FlowGenerator", obj(("SettingProfiles", obj(
        ("ActiveProfiles", obj(("TherapyProfile", text(active)))), ("TherapyProfiles", profiles), ("FeatureProfiles", features),
    )))))
    return orders(spark, sf).select("file_id", body.alias("text"))


def _shown(column: str) -> str:
    """One decimal of the number in a setting's text, then its unit."""
    return f"printf('%.1f', CAST(regexp_extract({column}, '[0-9.]+') AS DOUBLE)) || ' ' || regexp_extract({column}, '[A-Za-z0-9]+$')"


_SETTING_ROWS = (
    ("'Device'", "device", "true"), ("'Mode'", "mode", "true"), ("'Min EPAP'", _shown("pressure_min"), "bi AND ranged"), ("'Max IPAP'", _shown("pressure_max"), "bi AND ranged"),
    ("'IPAP'", _shown("ipap"), "bi AND NOT ranged"), ("'EPAP'", _shown("epap"), "bi AND NOT ranged"), ("'Respiratory rate (RR)'", _shown("respiratory_rate"), "bi"),
    ("'Tidal volume (Vt)'", _shown("tidal_volume"), "bi"), ("'Min pressure'", _shown("pressure_min"), "mode = 'APAP'"), ("'Max pressure'", _shown("pressure_max"), "mode = 'APAP'"),
    ("'Pressure'", _shown("pressure"), "mode = 'CPAP'"), ("'Ramp time'", "ramp_time", "true"), ("'Ramp pressure'", _shown("ramp_pressure"), "ramp_time <> 'Off'"),
    ("CASE WHEN pressure_relief LIKE 'PS:%' THEN 'Pressure support' ELSE 'Pressure relief' END", "regexp_replace(pressure_relief, '^PS: ', '')", "true"),
)


@query(
    "report_setting_rows",
    f"""WITH told AS (
SELECT *, 'device ' || file_id % 9 AS device, mode = 'BiPAP' AS bi, pressure_auto OR coalesce(pressure_min, pressure_max) IS NOT NULL AS ranged FROM ({JSON_SETTINGS}))
"""
    + "\nUNION ALL ".join(
        f"SELECT file_id, {n} AS pos, {label} AS label, {column} AS value FROM told WHERE {test} AND {column} IS NOT NULL"
        for n, (label, column, test) in enumerate(_SETTING_ROWS, 1)
    ),
    whole="pos",
)
def report_setting_rows(spark, sf):
    """The settings section of a report, of the settings read from JSON."""
    from noonday.plans.rows import setting_rows

    told = json_settings_of(spark, sf).withColumn("device", F.concat(F.lit("device "), s(F.col("file_id") % 9)))
    return setting_rows(told, K)


@query(
    "parse_xml_events",
    """
SELECT o_orderkey AS file_id, o_orderkey % 5 AS obstructive_apneas, o_orderkey % 3 AS central_apneas, CAST(0 AS BIGINT) AS obstructive_hypopneas,
  CAST(0 AS BIGINT) AS central_hypopneas, o_orderkey % 2 AS reras, p AS parameter, CASE p WHEN 7 THEN o_orderkey % 50 ELSE o_orderkey END AS value
FROM orders, (VALUES (7::BIGINT), (8::BIGINT)) AS t(p)""",
)
def parse_xml_events(spark, sf):
    k = F.col("k")

    def tags(code: int, n):
        return F.repeat(F.lit(f'<RespEvent Time="1" RespEventID="{code}" Pressure="3"/>\n'), n.cast("int"))

    def event(pid: int, value):
        return F.concat(F.lit(f'<DeviceEvent ParameterID="{pid}" Time="2" NewValue="'), s(value), F.lit('" DeviceEventID="0"/>'))

    text = F.concat(
        F.lit("<Events>"), tags(101, k % 5), tags(102, k % 3), tags(121, k % 2), tags(999, k % 4), event(7, k % 40),
        F.lit('<DeviceEvent DeviceEventID="3" ParameterID="7" NewValue="-9"/>'), event(8, k), event(7, k % 50), F.lit("</Events>"),
    )
    files = orders(spark, sf).select("file_id", text.alias("text"))
    return t.xml_event_counts(files, K).join(t.xml_parameters(files, K), K)


@query(
    "event_codes",
    "SELECT o_orderkey AS file_id, nullif(o_orderkey % 4 + o_orderkey % 3, 0) AS n_events FROM orders",
    nullable="n_events",
)
def event_codes(spark, sf):
    k = F.col("k")
    text = F.concat(
        F.repeat(F.lit("ID=17,T=3\n"), (k % 4).cast("int")), F.repeat(F.lit("id = 19 x\n"), (k % 3).cast("int")), F.lit("ID=20\n")
    )
    return t.event_codes(orders(spark, sf).select("file_id", text.alias("text")), K, [17, 18, 19])


@query(
    "parse_positional_csv",
    """
SELECT o_orderkey AS file_id, 's' || o_orderkey AS session_id, o_orderdate AS start_ts, o_orderdate + to_hours(o_orderkey % 9 + 1) AS end_ts,
  CASE WHEN o_orderkey % 5 = 1 THEN 'CPAP' WHEN o_orderkey % 5 IN (2, 3, 4) THEN 'APAP' WHEN o_orderkey % 10 = 0 THEN 'CPAP' ELSE 'APAP' END AS mode
FROM orders""",
    times="start_ts end_ts",
)
def parse_positional_csv(spark, sf):
    k = F.col("k")
    start = F.unix_millis("o_orderdate")
    spread = F.when(k % 10 == 0, "8.0").otherwise("12.5")
    line = F.concat_ws(
        ",", F.concat(F.lit(" s"), s(k)), s(start), s(start + (k % 9 + 1) * 3_600_000), spread, F.lit("8.0"), *[F.lit(str(i)) for i in range(5, 12)],
        s(k % 5), F.lit("extra"),
    )
    text = F.concat(line, F.lit("\r\nshort,line\r\nx,0,0,1,2,3,4,5,6,7,8,9,1\n"))
    files = orders(spark, sf).select("file_id", text.alias("text"))
    return t.positional_sessions(files, K).select("file_id", "session_id", "start_ts", "end_ts", "mode")


@query(
    "source_offset",
    """
WITH f AS (
  SELECT o_custkey AS card_id, o_orderkey AS k, CAST(floor(o_totalprice * 20) AS BIGINT) AS size, o_custkey % 2 = 0 AS resmed FROM orders),
o AS (
  SELECT card_id, k, CASE WHEN k % 4 = 0 THEN 'json' ELSE 'text' END AS source,
    CASE WHEN k % 4 = 0 THEN CASE WHEN resmed THEN (k % 12) * 60 + 30 END
         WHEN k % 4 <> 2 AND k % 3 = 0 AND size BETWEEN 1 AND 1500000 THEN (k % 9) * 60 + 30 END AS off FROM f),
b AS (SELECT card_id, arg_min(source, (source, k)) AS source, arg_min(off, (source, k)) AS off FROM o WHERE off IS NOT NULL GROUP BY card_id)
SELECT c.card_id, coalesce(off, CASE WHEN c.card_id % 3 > 0 THEN -480 END) AS offset_minutes,
  coalesce(source, CASE WHEN c.card_id % 3 > 0 THEN 'caller' END) AS source
FROM (SELECT DISTINCT card_id FROM f) c LEFT JOIN b ON b.card_id = c.card_id""",
    nullable="offset_minutes",
)
def source_offset(spark, sf):
    """Settings JSON, key-value texts on settings-like paths up to a size, the caller's value; some cards have none."""
    k = F.col("k")
    path = F.when(k % 4 == 0, F.concat(F.lit("SETTINGS/"), s(k), F.lit("/Settings/CurrentSettings.json"))).when(
        k % 4 == 1, F.concat(F.lit("config/"), s(k), F.lit(".txt"))
    ).when(k % 4 == 2, F.concat(F.lit("data/"), s(k), F.lit(".txt"))).otherwise(F.concat(s(k), F.lit("/profile.cfg")))
    texts = kv_files(spark, sf).select("file_id", F.col("text").alias("kv")).join(json_texts(spark, sf), "file_id")
    about = orders(spark, sf).select(
        "file_id", F.col("o_custkey").alias("card_id"), path.alias("path"), F.floor(F.col("o_totalprice") * 20).alias("size"),
        F.when(F.col("o_custkey") % 2 == 0, "resmed").otherwise("resvent").alias("family_id"), "k",
    )
    files = about.join(texts, "file_id").withColumn("text", F.when(k % 4 == 0, F.col("text")).otherwise(F.col("kv")))
    cards = about.select("card_id").distinct()
    default = F.when(F.col("card_id") % 3 > 0, F.lit(-480).cast("bigint"))
    return t.source_offset(cards, t.offset_candidates(files, 1_500_000), default)


@query(
    "settings_column_filter",
    """
SELECT l_orderkey, l_linenumber AS line, h, h IN ('Therapy Mode', 'Min-Pressure', 'EPAP Max', 'Press. Support (PS)', 'RR Set') AND h <> 'Press. Support (PS)' AS is_setting
FROM (SELECT *, ['Therapy Mode', 'Min-Pressure', 'EPAP Max', 'Press. Support (PS)', 'RR Set', 'AHI', 'Usage Hours'][(l_partkey + l_linenumber) % 7 + 1] AS h FROM lineitem)""",
    whole="line",
)
def settings_column_filter(spark, sf):
    names = F.array(*[F.lit(n) for n in ("Therapy Mode", "Min-Pressure", "EPAP Max", "Press. Support (PS)", "RR Set", "AHI", "Usage Hours")])
    lines = a.read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), "l_partkey")
    return lines.withColumn("h", F.get(names, ((F.col("l_partkey") + F.col("line")) % 7).cast("int"))).select(
        "l_orderkey", "line", "h", settings.is_setting_header("h").alias("is_setting")
    )


# --- scalar functions ------------------------------------------------------------------------------------------


@query(
    "safe_number",
    """
SELECT l_orderkey, l_linenumber AS line, CASE WHEN l_linenumber % 3 <> 2 THEN round(l_extendedprice, 2) END AS lead, round(l_extendedprice, 2) AS inside
FROM lineitem""",
    whole="line",
)
def safe_number(spark, sf):
    price = F.format_number("l_extendedprice", 2)
    n = F.col("l_linenumber") % 3
    text = F.when(n == 0, F.concat(F.lit("  "), price, F.lit(" L/min"))).when(n == 1, price).otherwise(
        F.concat(F.lit("about "), F.regexp_replace(price, ",", ""))
    )
    lines = a.read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), text.alias("x"))
    return lines.select("l_orderkey", "line", numbers.safe_number("x").alias("lead"), numbers.first_number("x").alias("inside"))


@query(
    "norm_pressure",
    "SELECT l_orderkey, l_linenumber AS line, round(CASE WHEN p < 0 THEN NULL WHEN p <= 80 THEN p WHEN p <= 8000 THEN p / 100 END, 6) AS pressure "
    "FROM (SELECT *, (l_extendedprice - 5000) / 10 AS p FROM lineitem)",
    whole="line",
)
def norm_pressure(spark, sf):
    p = (F.col("l_extendedprice") - 5000) / 10
    return a.read(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), numbers.norm_pressure(p).alias("pressure")
    )


@query(
    "norm_tidal_volume",
    """
SELECT l_orderkey, l_linenumber AS line, CASE WHEN ml >= 20 AND ml <= 5000 THEN round(ml, 6) END AS ml FROM (
  SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * 100 WHEN l_linenumber % 3 = 1 THEN l_quantity / 8 * 1000
    WHEN l_quantity * 3 <= 5 THEN l_quantity * 3000 ELSE l_quantity * 3 END AS ml FROM lineitem)""",
    whole="line",
)
def norm_tidal_volume(spark, sf):
    n = F.col("l_linenumber") % 3
    value = F.when(n == 0, F.col("l_quantity") * 100).when(n == 1, F.col("l_quantity") / 8).otherwise(F.col("l_quantity") * 3)
    unit = F.when(n == 0, "set mL").when(n == 1, "VT (L)").otherwise("")
    return a.read(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), numbers.norm_tidal_volume_ml(value, unit).alias("ml")
    )


@query(
    "norm_leak_unit",
    """
SELECT event_id, round(CASE WHEN event_id % 4 IN (0, 3) THEN value * 60 ELSE value END, 6) AS leak,
  round(CASE WHEN event_id % 4 = 1 THEN value ELSE value * 60 END, 6) AS assumed FROM events""",
)
def norm_leak_unit(spark, sf):
    n = F.col("event_id") % 4
    unit = F.when(n == 0, "L/s").when(n == 1, "L / min.").when(n == 2, "").otherwise("lps")
    return a.read(spark, sf, "events").select(
        "event_id", numbers.norm_leak_lpm("value", unit).alias("leak"),
        numbers.norm_leak_lpm("value", unit, assume_per_second=True).alias("assumed"),
    )


@query(
    "norm_usage_unit",
    """
SELECT event_id, round(CASE WHEN h >= 0 AND h <= 24 THEN h END, 6) AS hours FROM (
  SELECT *, CASE event_id % 4 WHEN 0 THEN value * 5 / 60 WHEN 1 THEN value * 300 / 3600 WHEN 2 THEN value / 10
    ELSE CASE WHEN value * 4 <= 24 THEN value * 4 ELSE value * 4 / 60 END END AS h FROM events)""",
)
def norm_usage_unit(spark, sf):
    n, v = F.col("event_id") % 4, F.col("value")
    value = F.when(n == 0, v * 5).when(n == 1, v * 300).when(n == 2, v / 10).otherwise(v * 4)
    unit = F.when(n == 0, "Minutes").when(n == 1, "sec").when(n == 2, "hrs").otherwise("")
    return a.read(spark, sf, "events").select("event_id", numbers.norm_usage_hours(value, unit).alias("hours"))


@query(
    "parse_datetime",
    """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate + INTERVAL 425 MINUTE WHEN 1 THEN o_orderdate + INTERVAL 47109 SECOND
  WHEN 4 THEN NULL ELSE o_orderdate + INTERVAL 12 HOUR END AS ts FROM orders""",
    times="ts",
)
def parse_datetime(spark, sf):
    d, n = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(n == 0, F.concat(F.lit("from "), F.date_format(d, "yyyy-MM-dd"), F.lit("T7:05 on")))
        .when(n == 1, F.concat(F.date_format(d, "MM/dd/yyyy"), F.lit(" 13:05:09")))
        .when(n == 2, F.concat(F.lit("x"), F.date_format(d, "yyyy-MM-dd"), F.lit("y")))
        .when(n == 3, F.date_format(d, "MM/dd/yyyy")).otherwise("13-45-2001")
    )
    return a.read(spark, sf, "orders").select("o_orderkey", dates.parse_datetime(text).alias("ts"))


@query(
    "parse_utc_offset",
    """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN o_orderkey % 20 <= 14 THEN -60 * (o_orderkey % 20) END
  WHEN 2 THEN CASE WHEN o_orderkey % 70 < 60 THEN (o_orderkey % 13) * 60 + o_orderkey % 70 END
  WHEN 3 THEN 90 END AS minutes FROM orders""",
    nullable="minutes",
)
def parse_utc_offset(spark, sf):
    k = F.col("o_orderkey")
    n = k % 5
    text = (
        F.when(n == 0, "utc").when(n == 1, F.concat(F.lit("-"), s(k % 20)))
        .when(n == 2, F.concat(F.lit("+"), s(k % 13), F.lit(":"), F.lpad(s(k % 70), 2, "0")))
        .when(n == 3, "GMT +01:30").otherwise("north")
    )
    return a.read(spark, sf, "orders").select("o_orderkey", dates.parse_utc_offset(text).alias("minutes"))


@query(
    "packed_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, "
    "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + INTERVAL 7 HOUR + to_minutes(o_orderkey % 60) END AS stamp FROM orders",
    days="day", times="stamp",
)
def packed_date(spark, sf):
    d = F.col("o_orderdate")
    month = F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(F.month(d))
    word = F.shiftleft(F.year(d) - 1980, 9) + F.shiftleft(month, 5) + F.dayofmonth(d)
    stamp = dates.timestamp_from_parts(
        1900, F.year(d) - 1900, month, F.dayofmonth(d), F.lit(7), F.col("o_orderkey") % 60, F.lit(0)
    )
    return a.read(spark, sf, "orders").select(
        "o_orderkey", dates.packed_date(word, 1980, 9, 5).alias("day"), stamp.alias("stamp")
    )


@query(
    "edf_datetime",
    "SELECT o_orderkey, o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 12 HOUR ELSE INTERVAL 82809 SECOND END AS ts FROM orders",
    times="ts",
)
def edf_datetime(spark, sf):
    time = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("23.00.09")
    return a.read(spark, sf, "orders").select(
        "o_orderkey", dates.edf_datetime(F.date_format("o_orderdate", "dd.MM.yy"), time).alias("ts")
    )


@query(
    "valid_timestamp",
    "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) END AS ts FROM events",
    times="ts",
)
def valid_timestamp(spark, sf):
    seconds = F.when(F.col("event_id") % 7 == 0, F.lit(-5)).otherwise(F.unix_timestamp("ts") - 1_000_000_000)
    return a.read(spark, sf, "events").select(
        "event_id", dates.timestamp_from_epoch(seconds, 1_000_000_000).alias("ts")
    )


@query(
    "format_number_trim",
    """
SELECT l_orderkey, l_linenumber AS line, CASE WHEN l_tax = 0 THEN 'Off' WHEN l_tax * 100 = 1 THEN '1 minute'
  ELSE CAST(CAST(round(l_tax * 100, 0) AS BIGINT) AS VARCHAR) || ' minutes' END AS ramp,
  CAST(l_quantity AS BIGINT) || CASE WHEN l_discount = 0 THEN '' WHEN l_discount = 0.1 THEN '.1' ELSE printf('%.2f', l_discount)[2:] END || ' cmH2O' AS pressure
FROM lineitem""",
    whole="line",
)
def format_number_trim(spark, sf):
    return a.read(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), numbers.ramp_time_text(F.round(F.col("l_tax") * 100, 2)).alias("ramp"),
        numbers.pressure_text(F.col("l_quantity") + F.col("l_discount")).alias("pressure"),
    )


@query(
    "format_date_human",
    "SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS text FROM orders",
)
def format_date_human(spark, sf):
    return a.read(spark, sf, "orders").select("o_orderkey", dates.human_date("o_orderdate").alias("text"))


@query(
    "text_clean",
    """
SELECT doc_id, md5(regexp_replace(text, '[^\\x09\\x0A\\x0D\\x20-\\x7E]', '', 'g')) AS digest,
  CAST(length(regexp_replace(text, '[^\\x09\\x0A\\x0D\\x20-\\x7E]', '', 'g')) AS BIGINT) AS n_chars FROM documents""",
)
def text_clean(spark, sf):
    clean = t.clean_text("text")
    return a.read(spark, sf, "documents").select(
        "doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("bigint").alias("n_chars")
    )


@query(
    "alias_pick",
    f"""
SELECT file_id, CAST({_USAGE} AS VARCHAR) AS usage, CAST(k % 1000 AS VARCHAR) AS press, 'Model ' || k % 5 AS device {_BASE}""",
)
def alias_pick(spark, sf):
    read = lambda *names: settings.read_alias("exact", "compact", names)
    return _maps(spark, sf).select(
        "file_id", read("therapyHours", "usage_hours").alias("usage"), read("pressure", "press").alias("press"),
        read("DEVICE").alias("device"),
    )


@query(
    "settings_from_kv",
    """
SELECT file_id, CASE m WHEN 1 THEN 'CPAP' WHEN 3 THEN 'APAP' WHEN 15 THEN 'PC' ELSE 'VentMode ' || m END AS mode,
  (k % 15 + 4) || '.5 cmH2O' AS pressure, '5 cmH2O' AS pressure_min, (k % 7 + 9) || ' cmH2O' AS pressure_max,
  CASE WHEN k % 2 = 0 THEN '6-' || (k % 9 + 7) || ' cmH2O' ELSE '6 cmH2O-' || (k % 9 + 7) || ' cmH2O' END AS epap,
  '9 cmH2O-' || (k % 5 + 12) || ' cmH2O' AS ipap, (k % 20) || ' bpm' AS respiratory_rate, (k % 400 + 200) || ' mL' AS tidal_volume,
  'PS ' || (k % 5) || ' cmH2O' AS pressure_relief, r AS ramp_time, CASE WHEN r <> 'Off' THEN (k % 4 + 4) || ' cmH2O' END AS ramp_pressure
FROM (SELECT o_orderkey AS file_id, o_orderkey AS k, [1, 3, 15, 99][o_orderkey % 4 + 1] AS m,
  CASE o_orderkey % 3 WHEN 0 THEN 'enabled' WHEN 1 THEN CASE o_orderkey % 45 WHEN 0 THEN 'Off' WHEN 1 THEN '1 minute' ELSE o_orderkey % 45 || ' minutes' END ELSE 'Off' END AS r
  FROM orders)""",
)
def settings_from_kv(spark, sf):
    """Ramp settings are named by an alias in every second file, by a key that only a pattern fits in the others."""
    k = F.col("k")
    mode = F.get(F.array(*[F.lit(x) for x in ("1", "3", "15", "99")]), (k % 4).cast("int"))
    text = F.concat(
        F.lit("VentMode="), mode, F.lit("\nPress="), s((k % 15 + 4) * 100 + 50),
        F.when(k % 2 == 0, F.concat(F.lit("\nEPAP=6-"), s(k % 9 + 7), F.lit(" cmH2O")))
        .otherwise(F.concat(F.lit("\nEPAP Min-Pressure=6\nepap_max pressure="), s(k % 9 + 7))),
        F.lit("\nbackup rate: "), s(k % 20), F.lit("\nPS="), s(k % 5), F.lit("\nPMin=5\nautoMax="), s(k % 7 + 9),
        F.lit("\nIPAP minimum=9\nIPAPMax="), s(k % 5 + 12), F.lit("\ntarget_vt: "), s(k % 400 + 200), F.lit(" mL"),
        F.when(k % 2 == 0, "\nrampTime=").otherwise("\nLast Ramp Duration of Night="),
        F.when(k % 3 == 0, "enabled").when(k % 3 == 1, s(k % 45)).otherwise("off"),
        F.when(k % 2 == 0, "\npRamp=").otherwise("\nPressure at Ramp="), s(k % 4 + 4),
    )
    files = orders(spark, sf).select("file_id", text.alias("text"))
    maps = t.value_maps(t.key_values(files, K), K)
    found = settings.with_settings(maps, entries="entries")
    return found.select("file_id", *[F.col(c).alias(c.removeprefix("set_")) for c in found.columns if c.startswith("set_")])


@query(
    "pressure_relief",
    """
SELECT o_orderkey AS file_id, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'IPR: Off' ELSE 'IPR: On ' || o_orderkey % 3 || ' cmH2O' END
  WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'EPR: Off' ELSE 'EPR: On ' || o_orderkey % 3 END
  WHEN 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Flex: Off' ELSE 'Flex: On ' || o_orderkey % 3 END
  ELSE CASE WHEN o_orderkey % 8 = 7 THEN 'ramp only' WHEN o_orderkey % 3 = 0 THEN 'EXHALE RELIEF: Off' ELSE 'EXHALE RELIEF: On ' || o_orderkey % 3 END END AS relief FROM orders""",
)
def pressure_relief(spark, sf):
    k = F.col("k")
    key = F.get(F.array(*[F.lit(x) for x in ("iPR=", "EPRLevel=", "C-Flex=", "Exhale Relief=")]), (k % 4).cast("int"))
    value = F.when(k % 8 == 7, "ramp only").otherwise(s(k % 3))
    files = orders(spark, sf).select("file_id", F.concat(F.lit("other=1\n"), key, value).alias("text"))
    maps = t.value_maps(t.key_values(files, K), K)
    return maps.select("file_id", settings.relief_text(F.col("exact"), F.col("lower"), F.col("entries")).alias("relief"))


@query(
    "ramp_rule",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Off' WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 3 = 1 THEN 'On' END
  WHEN o_orderkey % 45 = 1 THEN '1 minute' WHEN o_orderkey % 45 = 0 THEN 'Off' ELSE o_orderkey % 45 || ' minutes' END AS ramp_time,
  CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 10 + 4 <= 80 AND NOT (o_orderkey % 5 <> 0 AND o_orderkey % 45 = 0) THEN (o_orderkey % 10 + 4) || ' cmH2O' END AS ramp_pressure
FROM orders""",
)
def ramp_rule(spark, sf):
    k = F.col("o_orderkey")
    enable = F.when(k % 3 == 0, 0).when(k % 3 == 1, 1)
    minutes = F.when(k % 5 != 0, (k % 45).cast("double"))
    time, pressure = settings.ramp_rule(enable, minutes, (k % 10 + 4).cast("double"))
    return a.read(spark, sf, "orders").select("o_orderkey", time.alias("ramp_time"), pressure.alias("ramp_pressure"))


@query(
    "setting_number",
    """
SELECT o_orderkey, CAST(o_orderkey % 17 + 0.5 AS DOUBLE) AS first_number, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 17 + 0.5::DOUBLE END AS low,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 + 20 AS DOUBLE) END AS high FROM orders""",
)
def setting_number(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("about "), s(k % 17), F.lit(".5"), F.when(k % 2 == 0, F.concat(F.lit(" - "), s(k % 9 + 20))).otherwise(" cmH2O")
    )
    low, high = numbers.setting_range(text)
    return a.read(spark, sf, "orders").select(
        "o_orderkey", numbers.setting_number(text).alias("first_number"), low.alias("low"), high.alias("high")
    )


# Mode texts the mode queries draw from, and the class each belongs to.
MODE_TEXTS = (
    ("CPAP", "CPAP"), ("AutoSet for Her", "APAP"), ("Auto-CPAP", "APAP"), ("Bi_Level S/T", "BiPAP"), ("VPAP adapt", "BiPAP"),
    ("CPAP/Auto", "APAP"), ("auto S30", "BiPAP"), ("ST", "BiPAP"), ("fixed cpap", "CPAP"), ("unknown", None), ("AVAPS", "BiPAP"),
)


def machine_rows(spark, sf):
    """Settings of an order: a mode text and some of the settings fields."""
    k = F.col("k")
    texts = F.array(*[F.lit(m) for m, _ in MODE_TEXTS])
    mode = F.get(texts, (k % len(MODE_TEXTS)).cast("int"))
    cm = lambda n: F.concat(s(n), F.lit(" cmH2O"))
    return orders(spark, sf).select(
        "k", mode.alias("mode"),
        F.when(k % 3 != 0, cm(k % 15 + 4)).alias("pressure"),
        F.when(k % 4 == 0, cm(k % 7 + 4)).alias("pressure_min"),
        F.when(k % 4 == 0, cm(k % 7 + 10)).alias("pressure_max"),
        F.lit(None).cast("boolean").alias("pressure_auto"),
        F.when(k % 5 == 0, cm(k % 6 + 4)).alias("epap"),
        F.when(k % 5 == 0, cm(k % 6 + 9)).alias("ipap"),
        F.when(k % 7 == 0, F.concat(s(k % 12 + 8), F.lit(" bpm"))).alias("respiratory_rate"),
        F.lit(None).cast("string").alias("tidal_volume"),
    )


_CLASSES = "modes AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{m}', {repr(c) if c else 'NULL'})" for i, (m, c) in enumerate(MODE_TEXTS)
) + ") AS v(i, mode, class))"
MACHINE = f"""{_CLASSES},
machine AS (
  SELECT o_orderkey AS k, m.mode, m.class, o_orderkey % 3 <> 0 AS p, o_orderkey % 4 = 0 AS r, o_orderkey % 5 = 0 AS e, o_orderkey % 7 = 0 AS rr
  FROM orders JOIN modes m ON m.i = o_orderkey % {len(MODE_TEXTS)}),
classed AS (
  SELECT *, coalesce(class, CASE WHEN rr OR e THEN 'BiPAP' WHEN r THEN 'APAP' WHEN p THEN 'CPAP' END) AS canonical FROM machine)"""


@query("mode_normalize", "SELECT o_orderkey, 'bi level s t ' || o_orderkey % 9 AS mode FROM orders")
def mode_normalize(spark, sf):
    raw = F.concat(F.lit("Bi_Level   S/T - "), s(F.col("o_orderkey") % 9))
    return a.read(spark, sf, "orders").select("o_orderkey", modes.normalize_mode(raw).alias("mode"))


@query(
    "mode_classify",
    f"WITH {MACHINE}\nSELECT k, mode, class AS explicit, canonical FROM classed",
)
def mode_classify(spark, sf):
    rows = machine_rows(spark, sf)
    return rows.select("k", "mode", modes.explicit_mode("mode").alias("explicit"), modes.classify_mode("mode").alias("canonical"))


@query(
    "report_layout",
    f"WITH {MACHINE}\nSELECT k, CASE WHEN mode = 'auto S30' THEN 'one-page-cpap' WHEN canonical = 'BiPAP' THEN 'two-page-bipap' ELSE 'one-page-cpap' END AS layout FROM classed",
)
def report_layout(spark, sf):
    return machine_rows(spark, sf).select("k", modes.report_layout("mode").alias("layout"))


@query(
    "mode_field_sanitize",
    f"""WITH {MACHINE}
SELECT k, canonical AS canonical_mode, CASE WHEN class IS NULL THEN canonical ELSE mode END AS mode,
  CASE WHEN canonical = 'CPAP' THEN false WHEN canonical = 'APAP' THEN true WHEN canonical = 'BiPAP' THEN r OR mode IN ('VPAP adapt_', 'auto S30', 'AVAPS') ELSE false END AS pressure_auto,
  CASE WHEN canonical IN ('APAP', 'BiPAP') AND r THEN (k % 7 + 4) || ' cmH2O' END AS pressure_min,
  CASE WHEN canonical = 'BiPAP' AND e THEN (k % 6 + 4) || ' cmH2O' END AS epap,
  CASE WHEN canonical = 'BiPAP' AND rr THEN (k % 12 + 8) || ' bpm' END AS respiratory_rate
FROM classed""",
)
def mode_field_sanitize(spark, sf):
    return settings.resolve_machine(machine_rows(spark, sf)).select(
        "k", "canonical_mode", "mode", "pressure_auto", "pressure_min", "epap", "respiratory_rate"
    )


@query(
    "mode_verify",
    f"""WITH {MACHINE}
SELECT k, CASE WHEN canonical IS NULL THEN 'not verified'
  WHEN canonical = 'CPAP' THEN NULL WHEN canonical = 'APAP' THEN NULL
  WHEN rr OR e THEN NULL WHEN r OR mode IN ('auto S30', 'AVAPS') THEN 'inconsistent' WHEN p THEN 'inconsistent' END AS mode_error
FROM classed""",
)
def mode_verify(spark, sf):
    return settings.resolve_machine(machine_rows(spark, sf)).select("k", "mode_error")


@query(
    "mode_from_name",
    """
SELECT o_orderkey, ['APAP', 'BiPAP', 'APAP', 'BiPAP', 'CPAP', NULL][o_orderkey % 6 + 1] AS by_name,
  ['CPAP', 'APAP', 'BiPAP', 'BiPAP', NULL, NULL][o_orderkey % 6 + 1] AS by_model FROM orders""",
)
def mode_from_name(spark, sf):
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("o_orderkey") % 6).cast("int"))
    names = pick("AirSense HerAuto", "AirCurve 10 VAuto", "AirSense 10 AutoSet", "Lumis ST-A", "AirSense Elite", "box")
    models = pick("250P", "560PT", "760TS", "1061T", "1X", "")
    return a.read(spark, sf, "orders").select(
        "o_orderkey", modes.mode_from_name(names).alias("by_name"), modes.mode_from_model(models).alias("by_model")
    )


@query(
    "device_label",
    """
SELECT o_orderkey, ['AirSense 11 AutoSet', 'AirCurve 10 ST-A', 'S9', 'Other box'][o_orderkey % 4 + 1] AS device,
  CAST(o_orderkey AS VARCHAR) AS serial,
  ['AirSense 10 AutoSet for Her', 'AirCurve 11 VAuto', 'AirSense 10 Elite', 'Lumis 150 VPAP ST', NULL, 'Box ' || o_orderkey % 7][o_orderkey % 6 + 1] AS identity FROM orders""",
)
def device_label(spark, sf):
    """Names as written, and the identity out of a product object, an identification line, a device line, or a mention."""
    k = F.col("o_orderkey")
    raw = F.get(F.array(*[F.lit(x) for x in ("airsense_11  AUTOSET", "AirCurve10 ST-A", "my S9 unit", "Other_box ")]), (k % 4).cast("int"))
    path = F.concat(F.lit("vrem/od"), s(k), F.lit("/x.bin"))
    line = F.when(k % 6 == 2, "AirSense 10  Elite ").when(k % 6 == 4, "unknown")
    text = (
        F.when(k % 6 == 0, '{"ProductName": "AirSense 10   AutoSet for Her", "x": 1}')
        .when(k % 6 == 1, "#SRN 1\r\n  #PNA AirCurve_11 VAuto \r\n#PNA S9")
        .when(k % 6 == 3, "settings of a lumis150 vpap st").when(k % 6 == 5, F.concat(F.lit("#PNA Box "), s(k % 7))).otherwise("{broken S 9")
    )
    return a.read(spark, sf, "orders").select(
        "o_orderkey", modes.device_name(raw).alias("device"), modes.serial_from_path(path).alias("serial"), modes.device_identity(text, line).alias("identity")
    )


@query(
    "settings_signature",
    """
SELECT k, 'epap:' || (k % 6 + 4) || ' cmh2o|mode:bi level' || CASE WHEN k % 2 = 0 THEN '|pressureMin:4' ELSE '' END AS signature,
  'Bi Level EPAP ' || (k % 6 + 4) || ' cmH2O' AS label FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0)
UNION ALL SELECT o_orderkey, 'pressure:' || (o_orderkey % 9 + 4), 'Therapy ' || (o_orderkey % 9 + 4) FROM orders WHERE o_orderkey % 5 = 0""",
)
def settings_signature(spark, sf):
    k = F.col("o_orderkey")
    level = k % 5 != 0
    snap = settings.settings_snapshot(
        F.when(level, " Bi   Level "), F.when(~level, F.concat(F.lit("Fixed "), s(k % 9 + 4))), F.when(level & (k % 2 == 0), "4"),
        F.lit(""), F.when(level, F.concat(s(k % 6 + 4), F.lit(" (cmH2O)"))), F.lit(None).cast("string"),
    )
    return a.read(spark, sf, "orders").select(k.alias("k"), snap.alias("s")).select("k", "s.signature", "s.label")


@query(
    "sniff_content",
    """
SELECT o_orderkey, ['md300w1', NULL, 'somnopose', 'sleepstyle', 'icon', NULL][o_orderkey % 6 + 1] AS family FROM orders""",
)
def sniff_content(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % 6).cast("int"))
    name = pick(("a.dat", "b.dat", "c.csv", "d.fph", "e.fph", "f.bin"))
    head = F.when(k % 6 == 0, F.unhex(F.lit("000200000000180C1F17" + "3B3B"))).when(
        k % 6 == 1, F.unhex(F.lit("00020000000018FF1F173B3B"))
    ).otherwise(F.encode(pick(("", "", "Timestamp,Orientation\n1,2", "xx SleepStyle 2", "x ICON y", "plain")), "UTF-8"))
    size = F.lit(3000)
    return a.read(spark, sf, "orders").select("o_orderkey", t.sniff_family(name, size, head).alias("family"))
