"""Queries: EDF recordings, fixed-stride records, zip containers and kept tables, built from table columns."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day
from noonday.operators import catalogue, rollup
from noonday.plans import adapters as a
from noonday.plans.adapters import RECORDS, SAMPLES, with_views
from noonday.plans.registry import query
from noonday.plans.sql_parts import RECORD_DAYS
from noonday.session import checkpoint_dir
from noonday.sources import binary, sinks


def edf_files(spark, sf):
    """One recording per card and clinical day: a value signal and a constant one, two samples per record."""
    days = a.samples(spark, sf).groupBy("card_id", clinical_day("ts").alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "seq", F.floor(F.col("value") * 10).cast("int").alias("raw")))).alias("rows")
    )

    def le(n):
        big = F.lpad(F.hex(F.pmod(n, F.lit(65536))), 4, "0")
        return F.concat(F.substring(big, 3, 2), F.substring(big, 1, 2))

    def pad(text, width):
        return F.rpad(text if not isinstance(text, str) else F.lit(text), width, " ")

    signals = 2
    fixed = [("Leak", "Flat", 16), ("", "", 80), ("L/min", "x", 8), ("-3276.8", "-100", 8), ("3276.7", "100", 8), ("-32768", "-32768", 8),
             ("32767", "32767", 8), ("", "", 80), ("1", "2", 8), ("", "", 32)]
    header = F.concat(
        pad("0", 8), pad("card", 80), pad("night", 80), F.date_format("day", "dd.MM.yy"), F.lit("22.00.00"),
        pad(str(256 * (signals + 1)), 8), pad("", 44), pad(F.size("rows").cast("string"), 8), pad("2", 8), pad(str(signals), 4),
        *[pad(v, w) for one, two, w in fixed for v in (one, two)],
    )
    body = F.array_join(F.transform("rows", lambda r: F.concat(le(r["raw"]), F.lit("00800000"))), "")
    content = F.concat(F.encode(header, "ISO-8859-1"), F.unhex(body))
    return days.select("card_id", "day", F.when(F.col("card_id") % 10 == 9, F.substring(content, 1, 780)).otherwise(content).alias("content"))


@query(
    "decode_edf",
    with_views(SAMPLES, body="""
, leak AS (SELECT card_id, day, rn, n, floor(value * 10) / 10 AS value FROM (SELECT card_id, CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, value,
        row_number() OVER (PARTITION BY card_id, CAST(ts - INTERVAL 12 HOUR AS DATE) ORDER BY ts, seq) AS rn,
        count(*) OVER (PARTITION BY card_id, CAST(ts - INTERVAL 12 HOUR AS DATE)) AS n FROM samples)
  WHERE card_id % 10 <> 9 OR 768 + 6 * n <= 780)
SELECT card_id, day, 'Leak' AS channel, 'L/min' AS unit, rn - 1 AS seq, 2.0::DOUBLE AS sample_seconds,
  CAST(day AS TIMESTAMP) + INTERVAL 22 HOUR + to_seconds(2 * (rn - 1)) AS ts, round(value, 6) AS value FROM leak
UNION ALL
SELECT card_id, day, 'Flat', 'x', 2 * (rn - 1) + h, 1.0::DOUBLE, CAST(day AS TIMESTAMP) + INTERVAL 22 HOUR + to_seconds(2 * (rn - 1) + h),
  CASE h WHEN 0 THEN -100.0::DOUBLE ELSE round(32768 * (200.0::DOUBLE / 65535) - 100, 6) END
FROM leak, (VALUES (0), (1)) AS t(h)"""),
    days="day", times="ts",
)
def decode_edf(spark, sf):
    samples = binary.read_edf(edf_files(spark, sf), ["card_id", "day"])
    return samples.select("card_id", "day", "channel", "unit", "seq", "sample_seconds", "ts", "value")


def damaged_files(spark, sf):
    """The recordings, some of them spoilt by the last digit of the card: cut, packed and cut, no number, no header."""
    content, digit = F.col("content"), F.col("card_id") % 10
    no_number = F.concat(F.substring(content, 1, 236), F.encode(F.lit("nan     "), "ISO-8859-1"), F.expr("substring(content, 245)"))
    return edf_files(spark, sf).withColumn(
        "content",
        F.when(digit == 0, F.concat(F.unhex(F.lit("1F8B08000000000000FF")), F.substring(content, 1, 40)))
        .when(digit == 1, no_number).when(digit == 2, F.substring(content, 1, 200)).when(digit == 3, F.lit(None)).otherwise(content),
    )


@query(
    "reject_edf",
    with_views(SAMPLES, body="""
SELECT card_id, CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, CASE card_id % 10
  WHEN 0 THEN 'gzip stream is truncated or corrupt' WHEN 1 THEN 'header numbers are missing or not positive'
  WHEN 2 THEN 'shorter than a header' WHEN 3 THEN 'shorter than a header' ELSE 'data ends before the last record' END AS reason
FROM samples GROUP BY card_id, day HAVING card_id % 10 IN (0, 1, 2, 3) OR (card_id % 10 = 9 AND 768 + 6 * count(*) > 780)"""),
    days="day",
)
def reject_edf(spark, sf):
    return binary.rejected_edf(damaged_files(spark, sf), ["card_id", "day"])


LAYOUT = (
    binary.Field("line", 2, 1), binary.Field("part", 3, 4, little=False), binary.Field("supp", 7, 2),
    binary.Field("quantity", 9, 2, scale=0.5, null=24), binary.Field("year", 11, 1), binary.Field("month", 12, 1),
)


@query(
    "explode_fixed_records",
    """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1 AS record,
  l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CASE WHEN l_quantity <> 12 THEN l_quantity END AS quantity,
  year(l_shipdate) - 1900 AS year, month(l_shipdate) AS month FROM lineitem
QUALIFY l_linenumber <> 4""",
    whole="line year month record",
)
def explode_fixed_records(spark, sf):
    """Records of an order packed into one blob, then read back; line 4 carries a wrong sentinel."""
    def big(c, width):
        return F.lpad(F.hex(c.cast("bigint")), width * 2, "0")

    def little(c):
        h = big(c, 2)
        return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))

    line = a.read(spark, sf, "lineitem")
    record = F.concat(
        F.when(F.col("l_linenumber") == 4, "AAAB").otherwise("AAAA"), big(F.col("l_linenumber"), 1), big(F.col("l_partkey"), 4),
        little(F.col("l_suppkey")), little(F.col("l_quantity") * 2), big(F.year("l_shipdate") - 1900, 1), big(F.month("l_shipdate"), 1),
        F.lit("000000"),
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", record.alias("r"))
    blobs = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("rows")).select(
        "l_orderkey", F.unhex(F.array_join(F.transform("rows", lambda x: x["r"]), "")).alias("content")
    )
    return binary.fixed_records(blobs, ["l_orderkey"], 16, LAYOUT, b"\xaa\xaa")


def _zip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for conv, turns in zip(batch["conv_id"], batch["turns"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as archive:
                archive.writestr("readme.txt", "x")
                for turn, text in enumerate(turns):
                    archive.writestr(f"data/event_{turn:06d}.xml", text)
                    if turn % 2 == 0:
                        archive.writestr(f"data/SIGNAL_{turn:06d}.wmedf", text.encode()[::-1])
            out.append((conv, buffer.getvalue()))
        yield pd.DataFrame(out, columns=["conv_id", "content"])


@query(
    "explode_archive",
    """
SELECT conv_id, lpad(CAST(rn - 1 AS VARCHAR), 6, '0') AS session, md5(text) AS event_digest, CASE WHEN (rn - 1) % 2 = 0 THEN strlen(text) ELSE 0 END AS signal_bytes
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM conversations)""",
    whole="signal_bytes",
)
def explode_archive(spark, sf):
    talks = a.read(spark, sf, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns")
    )
    files = talks.mapInPandas(_zip, "conv_id long, content binary")
    pairs = binary.pair_members(binary.zip_members(files, ["conv_id"]), ["conv_id"])
    return pairs.select(
        "conv_id", "session", F.md5("event_text").alias("event_digest"),
        F.coalesce(F.octet_length("signal_bytes"), F.lit(0)).alias("signal_bytes"),
    )


@query(
    "files_to_days",
    with_views(SAMPLES, body="""
, days AS (SELECT card_id % 10 AS card_id, CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, count(*) AS n, round(sum(value), 6) AS total FROM samples GROUP BY ALL)
SELECT card_id, day, n, total FROM (SELECT *, max(day) OVER (PARTITION BY card_id) AS latest FROM days) WHERE day >= latest - 6"""),
    days="day",
)
def files_to_days(spark, sf):
    """Samples of ten cards as text files under two roots, a folder per card and day; listed by tasks, cut to the last
    seven days, read, and rolled up."""
    base = f"{checkpoint_dir(spark)}/card-files-{uuid.uuid4().hex}"
    line = F.concat_ws(",", F.col("seq").cast("string"), F.col("value").cast("string"))
    texts = a.samples(spark, sf).select((F.col("card_id") % 10).alias("card_id"), F.date_format(clinical_day("ts"), "yyyyMMdd").alias("day"), line.alias("value"))
    roots = [f"{base}/{name}" for name in ("even", "odd")]
    for n, root in enumerate(roots):
        texts.where(F.col("card_id") % 2 == n).repartition("card_id", "day").write.partitionBy("card_id", "day").text(root)
    listed = binary.list_files(spark, *roots).withColumn("file_id", F.col("uri"))
    recent = catalogue.recent_files(listed, 7).where("kept").withColumnRenamed("file_id", "uri")
    found = binary.with_content(recent.select("card_id", "uri", "path_date")).where("reason IS NULL")
    rows = found.select("card_id", "path_date", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    value = F.split("line", ",")[1].cast("double")
    return rows.groupBy(F.regexp_extract("card_id", "([0-9]+)$", 1).cast("bigint").alias("card_id"), F.col("path_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )


@query(
    "write_prepared",
    with_views(*RECORD_DAYS, body="SELECT card_id, clinical_day, round(usage_hours_sum, 6) AS usage_hours_sum, n_records FROM day_sums"),
    days="clinical_day",
)
def write_prepared(spark, sf):
    """Day buckets written once in card folders and read back."""
    path = f"{checkpoint_dir(spark)}/prepared-{uuid.uuid4().hex}"
    sinks.write_prepared(rollup.day_parts(a.records(spark, sf)), path)
    return sinks.read_prepared(spark, path).select("card_id", "clinical_day", "usage_hours_sum", "n_records")
