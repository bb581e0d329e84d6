"""Timing by settings period, warnings, report rows, the machine of a report, and the readers that feed them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from noonday.functions import modes, settings
from noonday.operators import catalogue, cleaning, matching, periods, series, signals
from noonday.plans import report, rows
from noonday.sources import text


def day(s):
    return dt.date.fromisoformat(s)


def ts(s):
    return dt.datetime.fromisoformat(s)


PERIODS = "card_id long, kind string, period_start date, period_end date"
SESSIONS = "card_id long, start_ts timestamp, end_ts timestamp, source_clinical_day date"


@pytest.fixture(scope="module")
def two_periods(spark):
    return spark.createDataFrame(
        [(1, "current", day("2024-02-10"), day("2024-02-20")), (1, "previous", day("2024-02-01"), day("2024-02-09"))], PERIODS
    )


def test_sessions_by_period(spark, two_periods):
    made = [
        (1, ts("2024-02-10 01:00:00"), None), (1, ts("2024-02-10 13:00:00"), None), (1, ts("2024-02-10 13:00:00"), day("2024-02-05")),
        (1, ts("2024-03-01 13:00:00"), None), (2, ts("2024-03-01 13:00:00"), day("1999-01-01")),
    ]
    sessions = spark.createDataFrame([(c, s, s + dt.timedelta(hours=6), d) for c, s, d in made], SESSIONS)
    got = sorted((r.card_id, str(r.start_ts)[5:13], r.kind) for r in cleaning.period_sessions(sessions, two_periods).collect())
    # the first lies in the clinical day of the one and the calendar day of the other; a card without periods keeps all
    assert got == [
        (1, "02-10 01", "current"), (1, "02-10 01", "previous"), (1, "02-10 13", "current"), (1, "02-10 13", "previous"), (2, "03-01 13", "current"),
    ]


def test_timing_of_each_period(spark, two_periods):
    """Nights before the change, mornings after it: each period has its own anchor and covers its own hours only."""
    made = []
    for n in range(9):
        made.append((1, ts("2024-02-01 22:00:00") + dt.timedelta(days=n), 7))
    for n in range(11):
        made.append((1, ts("2024-02-10 13:00:00") + dt.timedelta(days=n), 5))
    sessions = spark.createDataFrame([(c, s, s + dt.timedelta(hours=h), None) for c, s, h in made], SESSIONS)
    base = {"usage_compliant_days": 0, "days_in_window": 9, "daily_hours": 63.0}
    metrics = spark.createDataFrame(
        [(1, 9, "previous", day("2024-02-01"), day("2024-02-10"), *base.values()), (1, 9, "current", day("2024-02-12"), day("2024-02-21"), 0, 9, 45.0)],
        "card_id long, range_days int, kind string, effective_start date, window_end date, usage_compliant_days long, days_in_window long, daily_hours double",
    )
    got = {r.kind: r for r in report.timing_metrics(metrics, sessions, two_periods).collect()}
    assert got["previous"].anchor_minutes == 22 * 60 and got["current"].anchor_minutes == 13 * 60
    assert got["previous"].timed and got["current"].timed
    assert (got["previous"].principal_hours, got["current"].principal_hours) == (63.0, 45.0)
    assert (got["previous"].compliant_days, got["current"].compliant_days) == (9, 9)


def test_warnings_come_in_order_and_by_period(spark):
    columns = {
        "card_id": 1, "range_days": 30, "days_in_window": 12, "timed": True, "drift": True, "confidence": "low", "raw_coverage": 90.0, "daily_hours": 5.0,
        "days_with_usage": 3, "ahi_mean": 1.0, "n_leak_values": 1, "max_leak_30m": 1.0, "max_leak_60m": 1.0, "sustained_leak_minutes": 1.0, "guarded": True,
        "guard_text": "guard", "anchored_day": day("2024-01-31"),
    }
    kinds = (
        "card_id long, range_days int, days_in_window long, timed boolean, drift boolean, confidence string, raw_coverage double, daily_hours double, days_with_usage long, "
        "ahi_mean double, n_leak_values long, max_leak_30m double, max_leak_60m double, sustained_leak_minutes double, guarded boolean, guard_text string, anchored_day date, kind string"
    )
    metrics = spark.createDataFrame([(*columns.values(), "current"), (*columns.values(), "previous")], kinds)
    card = spark.createDataFrame([(1, "changed"), (2, "other card")], "card_id long, warning string")
    loader = spark.createDataFrame([(1, "loader")], "card_id long, warning string")
    context = report.card_warning("settings_changed", card).unionByName(report.card_warning("loader", loader))
    got = {r.kind: r.warnings for r in report.with_warnings(metrics, context).collect()}
    assert got["current"][:4] == ["loader", "changed", report.W_ANCHORED.format("January 31, 2024"), "guard"]
    assert got["current"][4].startswith("Only 12 days") and got["current"][5:] == [report.W_PRINCIPAL, report.W_DRIFT]
    assert got["previous"][0] == "loader" and "changed" not in got["previous"] and report.W_REVIEW in got["previous"]
    none = report.with_warnings(metrics.withColumns({"timed": F.lit(False), "daily_hours": F.lit(0.0), "days_in_window": F.lit(30), "guarded": F.lit(False)}).drop("anchored_day"))
    assert [r.warnings for r in none.where("kind = 'current'").collect()] == [[]]


def test_guard_warning(spark):
    made = [("2024-01-0%d" % n, "a" if n < 4 else "b") for n in range(1, 8)]
    days = spark.createDataFrame([(1, day(d), s, s.upper()) for d, s in made], "card_id long, clinical_day date, signature string, label string")
    found = report.guard_warning(days, periods.fan_out(days, (7, 3))).collect()
    assert [(r.range_days, r.guard_text) for r in found] == [(7, report.W_GUARD.format(
        7, "A from January 1, 2024 to January 3, 2024; B from January 4, 2024 to January 7, 2024", "B", "January 4, 2024"))]


def test_machine_of_a_report(spark):
    reports = spark.createDataFrame([(1, "current", 7.5), (1, "previous", 6.5), (2, "current", None)], "card_id long, kind string, pressure_mean double")
    imported = spark.createDataFrame([(1, "new box", "APAP", 11.0, 12.0)], "card_id long, device string, mode string, pressure_mean double, vt_mean double")
    own = spark.createDataFrame([(1, "previous", None, "CPAP"), (1, "current", "x", "y")], "card_id long, kind string, device string, mode string")
    got = {(r.card_id, r.kind): (r.device, r.mode, r.pressure_mean, r.vt_mean) for r in periods.report_machine(reports, imported, own).collect()}
    assert got == {(1, "current"): ("new box", "APAP", 7.5, None), (1, "previous"): ("new box", "CPAP", 6.5, None), (2, "current"): (None, None, None, None)}


def test_setting_texts(spark):
    frame = spark.createDataFrame(
        [("Fixed 6 cmH2O", "6.0 cmH2O"), ("4 - 10.25 cmH2O", "4.0-10.3 cmH2O"), (" auto ", "auto"), ("", None), (None, None), ("12", "12.0 cmH2O")], "t string, want string"
    )
    assert all(r.got == r.want for r in frame.select("want", rows.pressure_display("t").alias("got")).collect())
    litres = spark.createDataFrame([("500 mL", 0.5), ("0.5 L", 0.5), ("450", 0.45), ("2", 2.0), ("none", None), ("-1 L", None)], "t string, want double")
    assert all(r.got == r.want for r in litres.select("want", rows.volume_setting(F.col("t")).alias("got")).collect())


def test_slices_of_every_length(spark):
    """Slices longer than the chunks, equal ones, nested ones, one over all; records at every edge."""
    draw, slices = random.Random(3), []
    for n in range(120):
        start = draw.randrange(0, 40_000_000)
        slices.append(("f", draw.randrange(10_000), start, start + draw.choice([1, 500, 70_000, 3_000_000, 20_000_000])))
    slices += [("f", 9_999, 0, 1 << 33), ("f", 50, 65_536, 131_072), ("f", 51, 65_536, 131_072), ("g", 1, 5, 5), ("g", 2, 9, 4)]
    spots = sorted({x + d for _, _, a, b in slices for x in (a, b) for d in (-1, 0, 1) if x + d >= 0})
    records = [(f, n, at) for n, (f, at) in enumerate((f, at) for f in "fg" for at in spots)]
    got = matching.assign_to_slices(
        spark.createDataFrame(records, "f string, rec long, offset long"), spark.createDataFrame(slices, "f string, slice_no long, from_offset long, to_offset long"), ["f"], "rec",
    )
    want = {}
    for f, rec, at in records:
        held = [n for g, n, a, b in slices if g == f and a <= at < b]
        if held:
            want[f, rec] = min(held)
    assert {(r.f, r.rec): r.slice_no for r in got.collect()} == want


def test_natural_order(spark):
    names = ["a2", "a10", "a010", "A9", "b1/x20", "b1/x3", "b1/x", "a2b", "7", "07", "10", "x999999999999999999999", "x1000000000000000000000"]
    frame = spark.createDataFrame([(n,) for n in names], "path string")
    got = [r.path for r in frame.orderBy(series.natural_key("path"), "path").collect()]
    assert got == ["07", "7", "10", "a2", "a2b", "A9", "a010", "a10", "b1/x", "b1/x3", "b1/x20", "x999999999999999999999", "x1000000000000000000000"]
    assert series.newest_by_path(frame.where("path like 'b%'").withColumn("k", F.lit(1)), ["k"]).first().newest == "b1/x20"


def test_offset_sources(spark):
    kv = "utcOffset=+02:00\n"
    files = [
        (1, "resmed", 3, "a/Settings/CurrentSettings.json", 9, '{"FlowGenerator":{"SettingProfiles":{"ActiveProfiles":{},"TherapyProfiles":{"P":{"TherapyMode":"CPAP"}},"FeatureProfiles":{"TimeZoneFeature":{"TimeZoneOffset":"+05:30"}}}}}'),
        (1, "resmed", 1, "config/x.txt", 9, kv), (2, "resvent", 1, "config/x.txt", 99, kv), (2, "resvent", 2, "profile.ini", 9, "gmtOffset: -3"),
        (3, "resvent", 1, "data/x.txt", 9, kv), (4, "resvent", 1, "config/x.txt", 0, kv), (4, "resvent", 2, "config/x.bin", 9, kv),
    ]
    frame = spark.createDataFrame(files, "card_id long, family_id string, file_id long, path string, size long, text string")
    cards = frame.select("card_id").distinct()
    told = lambda limit: {r.card_id: (r.offset_minutes, r.source) for r in text.source_offset(cards, text.offset_candidates(frame, limit), F.when(F.col("card_id") == 3, F.lit(60).cast("long"))).collect()}
    assert told(None) == {1: (330, "json"), 2: (120, "text"), 3: (60, "caller"), 4: (None, None)}
    assert told(50)[2] == (-180, "text")


def test_settings_by_pattern(spark):
    files = spark.createDataFrame(
        [(1, "Ramp Duration: 20\nStart Ramp Pressure=5\nExhale=2\ntargetVT=450"), (2, "rampTime=off\nram press ramp=7\nmode: x"), (3, "flex mode: soft")], "file_id long, text string"
    )
    maps = text.value_maps(text.key_values(files, ["file_id"]), ["file_id"])
    got = {r.file_id: r for r in settings.with_settings(maps, entries="entries").collect()}
    assert (got[1].set_ramp_time, got[1].set_ramp_pressure, got[1].set_tidal_volume) == ("20 minutes", "5 cmH2O", "450 mL")
    assert (got[2].set_ramp_time, got[2].set_ramp_pressure) == ("Off", None)
    relief = {r.file_id: r.t for r in maps.select("file_id", settings.relief_text(F.col("exact"), F.col("lower"), F.col("entries")).alias("t")).collect()}
    assert relief == {1: "EXHALE: On 2", 2: None, 3: "soft"}


def test_device_identity(spark):
    texts = [('{"ProductName":"AirCurve 10  VAuto"}', None, "AirCurve 10 VAuto"), ("#IMF 1\n#PNA S9 ", "AirSense 11", "S9"), ("x", "my AirSense_11", "AirSense 11"), ("old sleepmate10 unit", "none", "Sleepmate 10"), ("x", "y", None)]
    frame = spark.createDataFrame(texts, "t string, line string, want string")
    assert all(r.got == r.want for r in frame.select("want", modes.device_identity("t", "line").alias("got")).collect())


def test_daily_signals(spark):
    made = [(1, ts("2024-01-05 10:00:00"), 0, "Leak.50", "L/s", 0.5), (1, ts("2024-01-05 10:00:00"), 1, "Leak", "L/min", 20.0), (1, ts("2024-01-05 10:00:00"), 1, "Press", "", 9.0), (1, ts("2024-01-05 10:00:00"), 0, "Press", "", 7.0)]
    frame = spark.createDataFrame(made, "card_id long, start_ts timestamp, seq long, channel string, unit string, value double")
    from noonday.functions.numbers import norm_leak_lpm

    found = signals.daily_records(frame, [("leak", 1, "leak.50"), ("leak", 2, "leak"), ("pressure", 1, "press")], {"leak": norm_leak_lpm}, ["pressure"]).orderBy("date").collect()
    assert [(str(r.date), r.leak, r.pressure, str(r.history_start), r.latest_pressure) for r in found] == [
        ("2024-01-05", 30.0, 7.0, "2024-01-04", 9.0), ("2024-01-06", 20.0, 9.0, "2024-01-04", 9.0)
    ]


def test_daily_signals_in_one_pass(spark):
    made = [(1, ts("2024-01-05 10:00:00"), 0, "Other", 1.0), (1, ts("2024-01-07 10:00:00"), 0, "Press", 7.0), (None, ts("2024-01-01 10:00:00"), 0, "Press", 5.0)]
    frame = spark.createDataFrame(made, "card_id long, start_ts timestamp, seq long, channel string, value double")
    found = signals.daily_records(frame, [("pressure", 1, "press")], settings=["pressure"])
    # a channel that is no metric makes no record, but its file is the card's first; a row without a card has none
    assert [(str(r.date), r.pressure, str(r.history_start), r.latest_pressure) for r in found.collect()] == [("2024-01-07", 7.0, "2024-01-04", 7.0)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_with_the_table(spark, monkeypatch):
    from noonday.plans import adapters, q_match, q_stream

    small = "/root/testdata/sf0.001"
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 100)
    events = adapters.read(spark, small, "events")
    assert adapters.dealt(events, "user_id").rdd.getNumPartitions() == -(-events.count() // 100) > 4
    # a task that groups lines by session holds a bounded number of them, and they are not grouped before they are dealt
    plan = q_match.lookup_codes(spark, small)._jdf.queryExecution().toString()
    assert "RepartitionByExpression [l_orderkey" in plan
    # arriving files are written by more than four tasks
    written = []
    read_days = q_stream.twins.read_days
    monkeypatch.setattr(q_stream.twins, "read_days", lambda s, path: (written.append(path), read_days(s, path))[1])
    q_stream.stream_new_cards(spark, small)
    arrived = spark.read.parquet(written[0].removesuffix("/days") + "/in")
    names = [f for f in arrived.inputFiles()]
    assert len({f.rsplit("/part-", 1)[1][:5] for f in names}) > 4


def test_windows_of_several_ranges(spark):
    days = spark.createDataFrame([(1, day("2024-01-30")), (2, day("2024-01-20")), (2, day("2024-01-02"))], "card_id long, clinical_day date")
    now = F.lit("2024-02-01 13:00:00").cast("timestamp")
    got = {(r.card_id, r.range_days): (str(r.window_end), str(r.anchored_day)) for r in periods.windows_with_fallback(days, now, F.lit(0), (7, 30)).collect()}
    assert got[1, 7] == ("2024-02-01", "None") and got[2, 30] == ("2024-02-01", "None") and got[2, 7] == ("2024-01-21", "2024-01-20")


def test_channel_without_samples_in_range(spark):
    """a session whose samples all lie out of a channel's range has no samples of it, as a number."""
    start = ts("2024-01-01 22:00:00")
    made = [(card, n, start + dt.timedelta(minutes=2 * n), value, 120.0) for card, value in ((1, 40.0), (2, 900.0)) for n in range(3)]
    samples = spark.createDataFrame(made, "card_id long, seq long, ts timestamp, value double, sample_seconds double")
    channels = {"vt": (F.col("value") / 25, (0, False, 5, True), 0.5)}
    got = signals.summarize_sessions(samples, ["card_id"], ["ts", "seq"], channels=channels).orderBy("card_id").collect()
    assert [(r.vt_samples, r.vt_avg is None) for r in got] == [(3, False), (0, True)]


def test_flags_by_kind_of_device(spark):
    """an automatic bilevel device is held against its two pressures, not against the single one."""
    told = spark.createDataFrame(
        [(1, "BiPAP", "8 cmH2O", "15 cmH2O", 5.0, 5.0, 5.0), (2, "APAP", "8 cmH2O", "15 cmH2O", 5.0, 5.0, 5.0)],
        "card_id long, mode string, pressure_min string, pressure_max string, pressure_mean double, ipap_mean double, epap_mean double",
    )
    none = ["pressure", "ipap", "epap", "respiratory_rate", "tidal_volume", "device"]
    told = told.withColumns({n: F.lit(None).cast("string") for n in none} | {n: F.lit(9.0) for n in ("rr_min", "vt_mean")})
    flags = rows.setting_flags(told)
    got = told.select("card_id", *[flags[f"{n}_low"].alias(n) for n in ("pressure", "ipap", "epap")]).orderBy("card_id").collect()
    assert [tuple(r)[1:] for r in got] == [(False, True, True), (True, False, False)]


def test_half_a_minute_rounds_up(spark):
    """hours of exactly half a minute more, with the last digits of a sum off either way."""
    from noonday.functions.circular import hours_text

    half = 227.5 / 60
    frame = spark.createDataFrame([(half,), (half - 4e-15,), (half + 4e-15,)], "hours double")
    assert [r[0] for r in frame.select(hours_text(F.col("hours"))).collect()] == ["3:48"] * 3


def test_tables_and_free_text_in_one_pass(spark):
    """the kind of a file is told inside its row, so nothing is joined or shuffled; each kind as by its own reader."""
    texts = [
        "Date,AHI,Leak\n2024-01-02,3,4\nn/a,1,1\n2024-01-03,5,6", "Date,AHI\nn/a,1\n2024-01-09 AHI 7,x", "AHI 4\n2024-01-05 07:00 AHI 5 leak 6\n\n",
        "Date,AHI", "Date\tAvg Pressure\n\n2024-01-02\t1200", "", None, "2024-01-02\n2024-01-03 AHI 9", "x,day\n1\n2,2024-05-06",
    ]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    tables = text.table_records(files, ["file_id"]).drop("settings")
    others = files.join(tables.select("file_id").distinct(), "file_id", "left_anti")
    want = tables.unionByName(text.line_records(others, ["file_id"]))
    got = text.any_records(files, ["file_id"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() >= 6
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_readings_and_records_without_lambdas(spark):
    """files are decoded and taken apart once each in Python; Spark interprets lambdas, which took most of the time."""
    texts = ["Date,AHI,Avg Pressure\r\n2024-01-02,3,1200\r\nn/a,1,1", "x AHI 4\n2024-01-05 07:00 AHI 5 leak 6", "no date"]
    raw = [texts[0].encode(), texts[0].encode("utf-16-le"), b"\x85 \xff" + texts[1].encode(), texts[2].encode(), b" \r\n\t", None]
    files = spark.createDataFrame([(i, b and bytearray(b)) for i, b in enumerate(raw)], "file_id long, content binary")
    read = text.decode_variants(files)
    found = {i: [r.text for r in read.where(F.col("file_id") == i).orderBy("variant").collect()] for i in range(len(raw))}
    assert found[0] == [texts[0], texts[0][4:]] and texts[0] in found[1] and found[3] == ["no date", "ate"] and found[4] == found[5] == []
    assert found[2] == ["� �" + texts[1], "AHI 4\n" + texts[1].split("\n")[1], "\x85 \xff" + texts[1], texts[1]]
    records = text.any_records(read, ["file_id", "variant"])
    best = {r.file_id: r.n_records for r in text.best_variant(records.groupBy("file_id", "variant").agg(F.count("*").alias("n_records")), ["file_id"]).collect()}
    assert best == {0: 1, 1: 1, 2: 1}
    assert {(r.ahi, r.pressure_avg) for r in records.where("file_id = 0 AND variant = 0").collect()} == {(3.0, 12.0)}
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("ArrowEvalPython") == 2


def test_python_readers_agree_with_the_columns(spark):
    """what reads whole texts in Python reads as the columns do, also odd dates, numbers and blanks."""
    from noonday.functions import dates, numbers

    odd = [
        "2024-01-02", "01/02/2024 5:07", "2024-02-30", "0000-02-29", "1900-02-29", "2024-02-29T23:59:60", "2024-13-01 10:00 12/31/2023 09:00:01", "2024-01-02 24:00",
        "n/a", "", " 7 x", "1,5", "+4.", ".5e2", "1e400", "-3", "- 3", "٣", "80", "80.5", "8001", "a  ", "\t a\x85 ", "\x0b x \x85", "\x1cq ",
    ]
    frame = spark.createDataFrame([(x,) for x in odd], "x string")
    number = numbers.safe_number("x")
    want = frame.select(
        "x", F.date_format(dates.parse_datetime("x"), "yyyy-MM-dd HH:mm:ss").alias("clock"), number.alias("number"),
        numbers.norm_pressure(number).alias("pressure"), text.strip("x").alias("stripped"),
    ).collect()
    for r in want:
        number = numbers.leading_number(r.x)
        assert (dates.wall_clock(r.x), number, numbers.pressure(number), text._stripped(r.x)) == (r.clock, r.number, r.pressure, r.stripped), r.x


FILES = "card_id long, file_id long, path string, size long, modified_at date"


def test_query_chooses_the_first_candidates_that_fit(spark, tmp_path):
    """candidates are taken in their order until 2,500 files or 220 MB; the others stay, marked."""
    from noonday.plans import REGISTRY

    rows = [(k, 10 + k % 10, 200_000.0, dt.datetime(1996, 1, 1 + k % 28)) for k in range(120)]
    rows += [(k, 20, 20.0, dt.datetime(1996, 1, 1 + k % 28)) for k in range(1_000, 6_000)] + [(7_000, 30, 1.0, dt.datetime(1996, 1, 1))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    got = REGISTRY["candidate_score_topk"].plan(spark, str(tmp_path)).collect()
    for card, most, size in ((1, 55, 4_000_000), (2, 2_500, 400), (3, 1, 20)):
        mine = [r for r in got if r.card_id == card]
        assert sum(r.chosen for r in mine) == min(most, len(mine)) and {(r.card_files, r.card_bytes) for r in mine} == {(len(mine), size * len(mine))}
        left = [r.score for r in mine if not r.chosen]
        assert not left or max(left) <= min(r.score for r in mine if r.chosen and not r.pinned)
    assert len([r for r in got if r.card_id == 1]) > 100 and len([r for r in got if r.card_id == 2]) > 4_000


@pytest.mark.parametrize("most_files,most_bytes", [(30, None), (None, 9_000_000), (70, 25_000_000), (2, None)])
def test_candidates_without_size_and_twice(spark, most_files, most_bytes):
    """files without a size, files listed twice and any letters of a path go through the choice, and none is lost."""
    draw = random.Random(3)
    names = ["STR.edf", "settings/a.json", "summary.csv", "x/record.dat", "p.000"]
    listed = [(1 + i % 2, draw.choice([i, None]), f"{draw.choice(['日本語フォルダ', 'ab', 'ab/ccccccc', ''])}/{draw.choice(names)}", draw.choice([None, 0, 500, 3_000_000]), None) for i in range(150)]
    frame = spark.createDataFrame(listed + listed[:60] + [(None, 1, "a/STR.edf", 5, None)], FILES)
    family = spark.createDataFrame([(1, "resmed"), (2, None)], "card_id long, family_id string")
    every = catalogue.best_candidates(frame, family).collect()
    got = catalogue.best_candidates(frame, family, max_files=most_files, max_bytes=most_bytes).collect()
    drop = lambda r: tuple(v for k, v in r.asDict().items() if k != "chosen")
    assert sorted(map(repr, map(drop, got))) == sorted(map(repr, map(drop, every)))
    null_first = lambda x: (x is not None, x or 0)
    want = []
    for card in (1, 2):
        used, size, over = 0, 0, False
        mine = [r for r in every if r.card_id == card]
        rest = [r for r in mine if not r.pinned]
        for turn in ("pinned", "rest"):
            over = False
            if turn == "pinned":
                turns = sorted((r for r in mine if r.pinned), key=lambda r: (r.path.encode(), null_first(r.file_id), null_first(r.size)))
            else:
                turns = sorted(rest, key=lambda r: (-r.score, r.size or 0, null_first(r.file_id), r.path.encode()))
            for r in turns:
                over = over or (most_files is not None and used + 1 > most_files) or (most_bytes is not None and size + (r.size or 0) > most_bytes)
                if not over:
                    used, size = used + 1, size + (r.size or 0)
                    want.append(drop(r))
                elif turn == "pinned" and r.score > 0:
                    rest.append(r)
    assert sorted(map(repr, (drop(r) for r in got if r.chosen))) == sorted(map(repr, want)) and 0 < len(want) < len(every)
