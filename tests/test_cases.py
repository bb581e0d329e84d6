"""Cases with known results."""

import datetime as dt
import gzip
import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from noonday.functions import circular, dates, numbers, settings
from noonday.operators import catalogue, cleaning, clock, matching, periods, rollup, series, sleep
from noonday.plans import report
from noonday.session import checkpoint_dir
from noonday.sources import binary, text
from noonday.streaming import twins


def day(s):
    return dt.date.fromisoformat(s)


def ts(s):
    return dt.datetime.fromisoformat(s)


def days_df(spark, rows):
    return spark.createDataFrame(rows, "card_id long, clinical_day date, signature string, label string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def files(spark, paths, size=100):
    rows = [(1, i, p, size) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "card_id long, file_id long, path string, size long")


# --- catalogue


def test_recent_window_drops_only_older_files(spark):
    got = catalogue.recent_files(
        files(spark, [f"DATALOG/{d}/x.edf" for d in ("20251225", "20251226", "20251227", "20260325")]), 90
    )
    assert sorted(r.file_id for r in got.where("NOT kept").collect()) == [0]
    assert one(catalogue.window_summary(got)).has_older


def test_dated_folders(spark):
    rows = [(1, day(d)) for d in ("2024-01-01", "2024-04-01", "2024-04-02")]
    got = catalogue.recent_folders(spark.createDataFrame(rows, "card_id long, folder_date date"), 2)
    assert sorted(str(r.folder_date) for r in got.collect()) == ["2024-04-01", "2024-04-02"]


def test_leaf_dates(spark):
    df = spark.createDataFrame([("DATALOG/20260325",), ("RECORD/202603/25",), ("RECORD/202603",)], "p string")
    assert [r[0] for r in df.select(catalogue.leaf_date("p")).collect()] == [day("2026-03-25"), day("2026-03-25"), None]


def test_impossible_path_dates_are_null(spark):
    df = spark.createDataFrame([("DATALOG/20260231/x",), ("2026-03-25/x",), ("a/x",)], "p string")
    assert [r[0] for r in df.select(catalogue.window_date("p")).collect()] == [None, day("2026-03-25"), None]


@pytest.mark.parametrize("first,expected,moved", [("DATALOG/20240101/STR.edf", "resvent", True), ("DATALOG/STR.edf", "resmed", False)])
def test_newer_family_overrides_only_a_dated_winner(spark, first, expected, moved):
    paths = [first, "IDENTIFICATION.tgt", "THERAPY/RECORD/202404/30/other.bin"]
    listed = catalogue.catalogue(files(spark, paths))
    row = one(catalogue.select_family(listed))
    assert (row.family_id, row.by_date) == (expected, moved)


def test_bundle(spark):
    row = one(catalogue.structure_flags(files(spark, ["a/1.usr", "a/1.idx", "a/1.000", "a/1.evt"])))
    assert (row.has_bundle, row.has_usr, row.index_only) == (True, True, False)
    assert one(catalogue.ranked_families(files(spark, ["a/1.usr", "a/1.idx", "a/1.000"])).where("rank = 1")).family_id == "bmc"


def test_day_budget_skips_an_oversize_day(spark):
    rows = [(1, i, day(d), n) for i, (d, n) in enumerate([("2024-01-04", 60), ("2024-01-03", 50), ("2024-01-02", 30), ("2024-01-01", 20)])]
    df = spark.createDataFrame(rows, "card_id long, file_id long, day date, size long")
    assert catalogue.day_budget(df).where("kept").count() == df.select("day").distinct().count()
    assert sorted(str(r.day) for r in catalogue.day_budget(df, "day", 100).where("kept").collect()) == ["2024-01-02", "2024-01-04"]


def test_candidate_limits_against_a_plain_walk(spark):
    draw = random.Random(8)
    names = ["STR.edf", "DATALOG/20240101/a.edf", "summary.csv", "x/record.dat", "session.txt", "SETTINGS/a.json", "notes.bin", "therapy/p.000"]
    rows = [(1 + i % 2, i, f"{draw.choice('abc')}/{draw.choice(names)}", draw.choice([10, 500, 600_000, 3_000_000])) for i in range(200)]
    frame = spark.createDataFrame([(c, i, p, n, None) for c, i, p, n in rows], "card_id long, file_id long, path string, size long, modified_at date")
    family = spark.createDataFrame([(1, "resmed"), (2, None)], "card_id long, family_id string")
    every = catalogue.best_candidates(frame, family).collect()
    assert all(r.chosen for r in every) and any(r.pinned for r in every)
    dates = {r.file_id: r.record_date for r in catalogue.catalogue(frame).collect()}
    for most_files, most_bytes in ((20, None), (None, 9_000_000), (35, 20_000_000)):
        chosen = set()
        for card in (1, 2):
            mine, n, size = [r for r in every if r.card_id == card], 0, 0
            fits = lambda k, b: (most_files is None or k <= most_files) and (most_bytes is None or b <= most_bytes)
            rest = [r for r in mine if not r.pinned]
            run = 0
            for k, r in enumerate(sorted((r for r in mine if r.pinned), key=lambda r: (r.path, r.file_id)), 1):
                run += r.size
                if fits(k, run):
                    chosen.add(r.file_id)
                    n, size = n + 1, size + r.size
                elif r.score > 0:
                    rest.append(r)
            run = size
            order = lambda r: (-r.score, dates[r.file_id] is None, -(dates[r.file_id].toordinal() if dates[r.file_id] else 0), r.size, r.file_id)
            for k, r in enumerate(sorted(rest, key=order), n + 1):
                run += r.size
                if fits(k, run):
                    chosen.add(r.file_id)
        got = catalogue.best_candidates(frame, family, max_files=most_files, max_bytes=most_bytes).collect()
        assert len(got) == len(every) and {r.file_id for r in got if r.chosen} == chosen


# --- roll-up and matching


def test_histogram_percentile(spark):
    df = spark.createDataFrame([(1.0, 10), (2.0, 1)], "bin double, n long")
    assert one(df.agg(rollup.histogram_percentile(0.95).alias("p"))).p == 1.5


def test_rates_need_valid_usage_and_all_parts(spark):
    df = spark.createDataFrame([(3.0, 2.0, 1.0), (3.0, 2.0, None), (3.0, 2.0, 0.0), (3.0, 2.0, 25.0), (3.0, None, 1.0)], "a double, b double, h double")
    got = df.select(rollup.hourly(rollup.all_or_none(F.col("a"), F.col("b")), "h").alias("r")).collect()
    assert [r.r for r in got] == [5.0, None, None, None, None]


def test_clock_offset_by_majority(spark):
    ends = [(1, ts("2026-03-01 22:00:00"), ts("2026-03-02 06:00:30"))] * 4 + [(2, ts("2026-03-01 22:00:00"), ts("2026-03-01 22:07:00"))]
    got = {r.card_id: (r.offset_minutes, r.verified) for r in clock.vote_clock_offset(
        spark.createDataFrame(ends, "card_id long, end_ts timestamp, modified_at timestamp")).collect()}
    assert got == {1: (480, 4), 2: (480, 0)}


def test_central_index_only_if_all_apneas_are_classified(spark):
    records = spark.createDataFrame([(1, 6.0, None, None), (2, 6.0, None, None)], "card_id long, usage_hours double, residual_apneas double, central_apneas double")
    events = spark.createDataFrame([(1, 3, 1, 1), (2, 2, 1, 1)], "card_id long, apneas long, centrals long, obstructives long")
    got = {r.card_id: r for r in matching.fill_from_events(records, events, ["card_id"]).collect()}
    assert (got[1].residual_apneas, got[1].central_apneas) == (0.5, None)
    assert got[2].central_apneas == pytest.approx(1 / 6)


def test_overlapping_sessions_first_running_one_takes_the_sample(spark):
    at = lambda m: ts("2026-01-01 22:00:00") + dt.timedelta(minutes=m)
    sessions = spark.createDataFrame([(1, at(0), at(60)), (1, at(30), at(90)), (1, at(40), at(50))], "card_id long, start_ts timestamp, end_ts timestamp")
    samples = spark.createDataFrame([(1, i, at(m)) for i, m in enumerate((0, 45, 60, 75, 91))], "card_id long, seq long, ts timestamp")
    got = {r.seq: r.start_ts for r in matching.assign_to_sessions(samples, sessions, ["seq"]).collect()}
    assert got == {0: at(0), 1: at(0), 2: at(0), 3: at(30)}


def test_points_go_to_the_nearest_day_once(spark):
    days = spark.createDataFrame([(1, day("2026-01-01"), 8.0), (1, day("2026-01-02"), 8.0)], "card_id long, day date, usage_hours double")
    points = spark.createDataFrame([(1, 9, ts("2026-01-01 22:00:00")), (1, 11, ts("2026-01-02 22:00:00"))], "card_id long, p long, ts timestamp")
    got = {r.p: str(r.day) for r in matching.assign_to_nearest_day(points, days, "p").collect()}
    assert got == {9: "2026-01-01", 11: "2026-01-02"}


def test_mixed_day_settings_nest(spark):
    rows = [(1, day("2026-01-01"), i, s, s.upper()) for i, s in enumerate("aabca")] + [(1, day("2026-01-02"), 9, "a", "A")]
    df = spark.createDataFrame(rows, "card_id long, clinical_day date, seq long, signature string, label string")
    got = {str(r.clinical_day): (r.signature, r.label) for r in rollup.mixed_day_settings(df).collect()}
    assert got["2026-01-02"] == ("a", "A")
    assert got["2026-01-01"] == ("mixed:a|mixed:c|mixed:a|b", "A + B + C")


def test_constant_or_null(spark):
    df = spark.createDataFrame([(1, 7.0), (1, 9.0), (2, 9.0)], "card_id long, v double")
    got = {r.card_id: r.c for r in df.groupBy("card_id").agg(rollup.constant_or_null("v").alias("c")).collect()}
    assert got == {1: None, 2: 9.0}


# --- series


def leak_samples(spark, card=1):
    start = ts("2026-01-01 22:00:00")
    values = [0.2, 0.6, 0.7, 0.1, 0.8, 0.9, 0.2]
    rows = [(card, i, start + dt.timedelta(seconds=2 * i), v, 2.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "card_id long, seq long, ts timestamp, raw double, sample_seconds double")
    return df.withColumn("value", F.round(numbers.norm_leak_lpm("raw", F.lit("L/s")), 6))


def test_leak_episodes(spark):
    runs = series.threshold_runs(leak_samples(spark), ["card_id"], ["ts", "seq"])
    row = one(series.best_episodes(runs, ["card_id"]))
    assert (row.max_leak, row.longest_leak, row.n_runs) == (54.0, 54.0, 2)
    assert row.max_leak_minutes * 60 == pytest.approx(4) and row.longest_minutes * 60 == pytest.approx(4)


def test_mask_session_ends_at_last_active_sample(spark):
    start = ts("2026-01-01 22:00:00")
    rows = [(1, i, start + dt.timedelta(seconds=i), i < 300) for i in range(601)]
    df = spark.createDataFrame(rows, "card_id long, seq long, ts timestamp, active boolean")
    row = one(series.mask_sessions(df, ["card_id"], ["ts", "seq"], F.col("active")))
    assert 0.08 < (row.end_ts - row.start_ts).total_seconds() / 3600 < 0.1


# --- periods


def runs_of(start, *lengths):
    rows, at = [], day(start)
    for n, length in enumerate(lengths):
        for _ in range(length):
            rows.append((1, at, f"s{n}", f"S{n}"))
            at += dt.timedelta(days=1)
    return rows


def test_settings_guard_contracts_the_window(spark):
    days = days_df(spark, runs_of("2025-12-24", 60, 30))
    chosen = periods.guard_settings(periods.window_days(days, periods.fan_out(days, (90,))))
    assert chosen.count() == 30
    assert one(chosen.select("effective_start").distinct()).effective_start == day("2026-02-22")


def test_previous_period_is_capped(spark):
    got = {r.kind: r for r in periods.settings_periods(days_df(spark, runs_of("2025-10-01", 20, 140, 21))).collect()}
    assert got["previous"].days_with_data == 90 and got["current"].days_with_data == 21


def test_window_falls_back_to_latest_data(spark):
    days = days_df(spark, [(1, day("2026-03-17") + dt.timedelta(days=i), "s", "S") for i in range(7)])
    row = one(periods.windows_with_fallback(days, F.lit("2026-04-16 12:00:00").cast("timestamp"), F.lit(0), 7))
    assert (row.window_start, row.window_end, row.anchored_to_latest) == (day("2026-03-17"), day("2026-03-24"), True)


def test_window_to_now_uses_the_card_offset(spark):
    _, end = periods.window_to_now(F.lit("2026-03-08 07:30:00").cast("timestamp"), F.lit(-480), 7)
    assert one(spark.range(1).select(F.date_sub(end, 1).alias("d"))).d == day("2026-03-06")


@pytest.mark.parametrize("known,expected", [(None, [(7, 6, 2)]), ("2025-12-26", [(7, 7, 1), (90, 90, 1)])])
def test_range_fan_out(spark, known, expected):
    last = [("2026-03-19",), ("2026-03-24",)] if known is None else [("2026-03-25",)]
    days = days_df(spark, [(1, day(d[0]), "s", "S") for d in last])
    history = None if known is None else spark.createDataFrame([(1, day(known))], "card_id long, history_start date")
    wanted = (90, 60, 30, 7) if known is None else (90, 7)
    rows = periods.window_days(days, periods.fan_out(days, wanted), history).withColumn(
        "n", periods.effective_days(F.col("effective_start"), F.col("window_end"), F.col("range_days"))
    ).where(periods.enough_days(F.col("range_days"), F.col("n")))
    got = rows.groupBy("range_days", "n").count().collect()
    assert sorted((r.range_days, r.n, r["count"]) for r in got) == expected


def test_lookback(spark):
    df = spark.createDataFrame([(7.9,), (0.0,), (-3.0,), (float("nan"),), (None,), (400.0,)], "v double")
    assert [r[0] for r in df.select(periods.lookback_days(F.col("v"), F.lit(181))).collect()] == [7, 90, 90, 90, 90, 181]


# --- sleep timing


def session(d, hour, hours, card=1):
    start = dt.datetime(2026, 1, 1) + dt.timedelta(days=d, hours=hour)
    return card, start, start + dt.timedelta(hours=hours)


def sessions_df(spark, rows):
    return spark.createDataFrame(rows, "card_id long, start_ts timestamp, end_ts timestamp")


def test_profile_of_a_day_sleeper_with_naps(spark):
    rows = [session(d, 8, 7) for d in range(30)] + [session(d, 20, 1) for d in range(0, 30, 2)]
    row = one(sleep.sleep_profiles(sessions_df(spark, rows)))
    assert 7 * 60 <= row.anchor_minutes <= 9 * 60 and row.confidence == "high" and not row.drift


def test_one_outlier_does_not_move_the_anchor(spark):
    rows = [session(d, 8, 7) for d in range(29)] + [session(29, 22, 10)]
    row = one(sleep.sleep_profiles(sessions_df(spark, rows)))
    assert 7.5 * 60 <= row.anchor_minutes <= 8.5 * 60


def classify(spark, rows, anchor):
    profile = spark.createDataFrame([(1, float(anchor), float((anchor - 480) % 1440))], "card_id long, anchor_minutes double, boundary_minutes double")
    return sleep.classify_days(sleep.with_sleep_day(sessions_df(spark, rows), profile))


def test_nap_and_principal_episode(spark):
    row = one(sleep.classify_totals(classify(spark, [session(0, 14, 1.5), session(0, 22, 3)], 22 * 60)))
    assert (row.total_minutes, row.principal_minutes, row.nap_minutes, row.timed_compliant_days) == (270, 180, 90, 0)


def test_short_break_is_one_episode(spark):
    row = one(classify(spark, [session(0, 22, 2), session(0, 24 + 20 / 60, 2.5)], 22 * 60))
    assert (row.n_episodes, row.principal_minutes, row.four_hours) == (1, 270, True)


def test_drift(spark):
    rows = [session(d, 8, 7) for d in range(20)] + [session(d, 22, 7) for d in range(20, 40)]
    assert one(sleep.schedule_drift(sessions_df(spark, rows))).drift


# --- scalars


def test_clock_texts(spark):
    row = one(spark.range(1).select(
        circular.clock_text(F.lit(480.0)), circular.clock_text(F.lit(1325.0)), circular.hours_text(F.lit(0.2)), circular.hours_text(F.lit(2.033))))
    assert tuple(row) == ("8:00 AM", "10:05 PM", "0:12", "2:02")


def test_staleness(spark):
    df = spark.createDataFrame([(n,) for n in (7, 8, 30, 31, 90, 91)], "n int")
    got = [r[0] for r in df.select(dates.staleness(F.col("n"))).collect()]
    assert got == [None, "notice", "notice", "warning", "warning", "critical"]


def test_numbers_of_missing_values_stay_missing(spark):
    df = spark.createDataFrame([(None,), (float("6.50"),)], "v double")
    assert [r[0] for r in df.select(numbers.pressure_text("v")).collect()] == [None, "6.5 cmH2O"]


# --- files


def edf(rate=(2, 1), records=3):
    labels = ["Leak", "Press"]
    fields = [(["Leak.2s", labels[1]], 16), (["", ""], 80), (["L/s", "cmH2O"], 8), (["0", "0"], 8), (["2", "40"], 8), (["0", "0"], 8),
              (["200", "400"], 8), (["", ""], 80), ([str(r) for r in rate], 8), (["", ""], 32)]
    head = "0".ljust(8) + "p".ljust(80) + "r".ljust(80) + "01.02.26" + "22.10.05" + str(256 * 3).ljust(8) + " " * 44 + str(records).ljust(8) + "4".ljust(8) + "2".ljust(4)
    head += "".join(v.ljust(w) for values, w in fields for v in values)
    body = b"".join(struct.pack("<3h", 10 * i, 10 * i + 5, 40 + i) for i in range(records))
    return head.encode("latin-1") + body


def test_edf_plain_gzip_and_truncated(spark):
    data = edf()
    rows = [(1, bytearray(data)), (2, bytearray(gzip.compress(data))), (3, bytearray(data[:-1])), (4, bytearray(b"junk"))]
    got = binary.read_edf(spark.createDataFrame(rows, "card_id long, content binary"), ["card_id"]).collect()
    assert {r.card_id for r in got} == {1, 2}
    leak = sorted((r for r in got if r.card_id == 2 and r.channel == "Leak.2s"), key=lambda r: r.seq)
    assert [round(r.value, 6) for r in leak] == [0.0, 0.05, 0.1, 0.15, 0.2, 0.25]
    assert leak[1].ts == ts("2026-02-01 22:10:07") and leak[0].sample_seconds == 2.0
    press = sorted((r for r in got if r.card_id == 1 and r.channel == "Press"), key=lambda r: r.seq)
    assert [round(r.value, 6) for r in press] == [4.0, 4.1, 4.2] and press[2].ts == ts("2026-02-01 22:10:13")


def test_fixed_records(spark):
    good = b"\xaa\xaa" + bytes([7]) + struct.pack("<H", 0xFFFF) + struct.pack("<I", 70000) + b"\0" * 7
    bad = b"\xaa\xab" + good[2:]
    blob = good + bad + good[:4] + b"\x01\x00" + good[6:] + b"tail"
    layout = (binary.Field("n", 2, 1), binary.Field("v", 3, 2, scale=0.1, null=0xFFFF), binary.Field("w", 5, 4))
    df = spark.createDataFrame([(1, bytearray(blob))], "card_id long, content binary")
    got = sorted(binary.fixed_records(df, ["card_id"], 16, layout, b"\xaa\xaa").collect(), key=lambda r: r.record)
    assert [(r.record, r.n, r.v) for r in got][0] == (0, 7, None)
    assert [r.record for r in got] == [0, 2] and got[0].w == 70000


def test_damaged_recordings_are_rows_with_a_reason(spark):
    data, packed = edf(), gzip.compress(edf())
    header = lambda text: data[:236] + text.ljust(8).encode() + data[244:]
    blobs = [data, packed[:-9], packed[:20] + b"\0\0\0\0" + packed[24:], header("nan"), header("inf"), header("-1"), b"", None, data[:-1]]
    frame = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(blobs)], "card_id long, content binary")
    assert {r.card_id for r in binary.read_edf(frame, ["card_id"]).collect()} == {0}
    reasons = {r.card_id: r.reason for r in binary.rejected_edf(frame, ["card_id"]).collect()}
    assert sorted(reasons) == list(range(1, 9)) and "gzip" in reasons[1] and "gzip" in reasons[2] and "numbers" in reasons[3]


def test_damaged_members_are_rows_with_a_reason(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("event_000001.xml", "<a/>" * 50)
        z.writestr("event_000002.xml", "<b/>" * 50)
    good = buffer.getvalue()
    bad = good.replace(b"<a/><a/>", b"<a/><x/>", 1)
    frame = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(bad)), (3, bytearray(b"junk")), (4, None)], "card_id long, content binary")
    found = binary.zip_members(frame, ["card_id"])
    told = {(r.card_id, r.session) for r in found.where("reason IS NOT NULL").collect()}
    assert told == {(2, "000001"), (3, None), (4, None)}
    assert {(r.card_id, r.session) for r in binary.pair_members(found, ["card_id"]).collect()} == {(1, "000001"), (1, "000002"), (2, "000002")}


def test_zip_members(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/event_000123.xml", "<x/>")
        z.writestr("a/signal_000123.wmedf", b"\x01\x02")
        z.writestr("other.txt", "no")
    df = spark.createDataFrame([(1, bytearray(buffer.getvalue())), (2, bytearray(b"no zip"))], "card_id long, content binary")
    row = one(binary.pair_members(binary.zip_members(df, ["card_id"]), ["card_id"]))
    assert (row.session, row.event_text, bytes(row.signal_bytes)) == ("000123", "<x/>", b"\x01\x02")


def test_key_values(spark):
    raw = b"\x01\x02\x03\x04A: 1=2\r\nkey=x\r\nkey = y\nblob,aa=1;bb=2 3"
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(raw[4:].decode().encode("utf-16-le")))], "f long, content binary")
    variants = text.decode_variants(df)
    pairs = text.key_values(variants, ["f", "variant"])
    for f in (1, 2):
        found = [dict((r.key, r.value) for r in pairs.where((F.col("f") == f) & (F.col("variant") == v)).collect()) for v in range(8)]
        assert {"A": "1=2", "key": "y", "blob,aa": "1;bb=2 3", "aa": "1", "bb": "2 3"} in found


def test_listing(spark, tmp_path):
    folder = tmp_path / "c1" / "DATALOG" / "20260325"
    folder.mkdir(parents=True)
    (folder / "a.edf").write_bytes(b"12345")
    listed = binary.list_files(spark, str(tmp_path))
    row = one(listed)
    assert (row.card_id, row.path, row.size, row.record_date) == ("c1", "DATALOG/20260325/a.edf", 5, day("2026-03-25"))
    (folder / "b.edf").write_bytes(b"other")
    assert bytes(one(binary.with_content(listed.where("path LIKE '%a.edf'"))).content) == b"12345"
    gone = listed.withColumn("uri", F.concat("uri", F.lit(".gone"))).where("path LIKE '%a.edf'")
    row = one(binary.with_content(gone))
    assert row.content is None and row.reason == "FileNotFoundError"


def test_listing_of_two_roots(spark, tmp_path):
    """Level by level: deep and empty folders, blanks and other scripts in names, hidden names, a root that is missing."""
    names = ["c1/a b/é/x 1.txt", "c1/top.txt", "c2/p/q/r/s/t/deep.edf", "c2/.hidden/x", "c2/_tmp/x", "plain.txt"]
    for root in ("left", "right side"):
        for name in names:
            file = tmp_path / root / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(f"{root}:{name}")
        (tmp_path / root / "c3" / "empty").mkdir(parents=True)
    roots = [str(tmp_path / "left"), f"file:{tmp_path / 'right side'}/", str(tmp_path / "none")]
    listed = binary.list_files(spark, *roots)
    seen = sorted((r.card_id, r.path) for r in listed.collect())
    assert seen == sorted(2 * [("c1", "a b/é/x 1.txt"), ("c1", "top.txt"), ("c2", "p/q/r/s/t/deep.edf"), ("", "plain.txt")])
    read = binary.with_content(listed).select(F.col("content").cast("string").alias("text"), "reason").collect()
    assert sorted(r.text for r in read) == sorted(f"{root}:{n}" for root in ("left", "right side") for n in names if "/." not in n and "/_" not in n)


def test_places():
    assert binary.located("/a/b c") == ("file://", "/a/b c") and binary.located("file:/a") == ("file://", "/a")
    assert binary.located("s3a://bucket-1/x/y") == ("s3a://bucket-1", "/x/y") and binary.located("hdfs://n1:8020/x") == ("hdfs://n1:8020", "/x")
    places = binary.Places()
    assert places("file:///tmp/x")[0] is places("/tmp/y")[0]


def test_alternatives_as_text(spark):
    from noonday.plans.rows import either

    lists = [([], ""), (["a"], "a"), (["a", "b"], "a or b"), (["a", "b", "c"], "a, b, or c")]
    frame = spark.createDataFrame(lists, "n array<string>, t string")
    assert all(r.got == r.t for r in frame.select("t", either(F.col("n")).alias("got")).collect())


def test_slices_against_brute_force(spark):
    draw = random.Random(6)
    slices = []
    for n in range(80):
        start = draw.randrange(5_000)
        slices.append((draw.choice("ab"), n, start, start + draw.choice([0, 1, 7, 300, 4_500])))
    records = [(draw.choice("ab"), n, draw.randrange(6_000)) for n in range(500)]
    for size in (1, 32):
        got = matching.assign_to_slices(
            spark.createDataFrame(records, "f string, rec long, offset long"), spark.createDataFrame(slices, "f string, slice_no long, from_offset long, to_offset long"),
            ["f"], "rec", record_size=size,
        )
        want = {}
        for f, rec, at in records:
            held = [n for g, n, x, y in slices if f == g and x // size * size <= at < y]
            if held:
                want[f, rec] = min(held)
        assert {(r.f, r.rec): r.slice_no for r in got.collect()} == want


# --- whole properties


def records_df(spark, card):
    rows = []
    for i in range(40):
        rows.append((card, i, ts("2026-01-01 20:00:00") + dt.timedelta(hours=9 * i), float(i % 9), float(i % 13), float(i % 50)))
    base = spark.createDataFrame(rows, "card_id long, seq long, date timestamp, usage_hours double, ahi double, leak double")
    names = [*cleaning.FIELD_RANGES, "max_leak_duration_value", "vt_samples", "rr_samples"]
    missing = {c: F.lit(None).cast("double") for c in names if c not in base.columns}
    return base.withColumns(missing).withColumns({"settings_signature": F.lit("s"), "settings_label": F.lit("S")})


def plain(df, drop=()):
    return sorted(map(tuple, df.drop(*drop).collect()), key=repr)


def test_rollup_is_mergeable_and_order_free_and_does_not_leak(spark):
    a, b = records_df(spark, 1), records_df(spark, 2)
    whole = rollup.day_parts(a)
    halves = rollup.day_parts(a.where("seq % 2 = 0")).unionByName(rollup.day_parts(a.where("seq % 2 = 1")))
    cols = ["clinical_day", "usage_hours_sum", "usage_hours_n", "ahi_weighted_sum", "leak_sum", "n_records"]
    assert plain(rollup.merge_day_parts(halves).select(cols)) == plain(whole.select(cols))
    assert plain(rollup.day_parts(a.orderBy(F.desc("seq")).repartition(7)).select(cols)) == plain(whole.select(cols))
    both = rollup.day_parts(a.unionByName(b))
    assert plain(both.where("card_id = 1"), ["card_id"]) == plain(both.where("card_id = 2"), ["card_id"])


def test_report_of_three_days(spark):
    base = records_df(spark, 1).where("seq < 3").withColumns(
        {"date": F.timestamp_seconds(F.unix_timestamp(F.lit("2026-03-23 22:00:00")) + F.col("seq") * 86400), "usage_hours": F.col("seq") + 6.0}
    )
    days = rollup.finish_days(rollup.day_parts(base)).withColumns({"signature": F.lit("s"), "label": F.lit("S")})
    row = one(report.report_metrics(days, periods.fan_out(days, (3,))).where("range_days = 3"))
    assert (row.days_in_window, row.avg_usage_hours, row.usage_compliant_days) == (3, 7.0, 3)
    assert (row.shown_start, row.shown_end) == (day("2026-03-23"), day("2026-03-25"))


def test_streams_equal_batch(spark, tmp_path):
    """Three files, one micro-batch each, then the end marker: all windows and runs, also those across batches."""
    start = ts("2026-01-01 12:00:00")
    rows = [(c, i, start + dt.timedelta(minutes=20 * i + (600 if i > 100 else 0)), float((i * 7) % 60), 120.0) for c in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "card_id long, seq long, ts timestamp, value double, sample_seconds double")
    for part in range(3):
        df.where(F.floor(F.col("seq") / 100) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(build, name):
        end = str(tmp_path / f"{name}-end")
        spark.createDataFrame([], df.schema).write.parquet(end)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        writer = (build(twins.with_end(stream, end)).writeStream.format("parquet").option("path", str(tmp_path / name))
                  .option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True))
        writer.start().awaitTermination()
        twins.mark_end(spark, df.schema, end)
        writer.start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))

    days = df.groupBy("card_id", dates.clinical_day("ts").alias("d")).agg(F.count("*"), F.sum("value"), F.max("value"))
    assert run(twins.stream_day_rollup, "days") == sorted(map(tuple, days.collect()))

    active = F.col("value") > 40
    masks = series.mask_sessions(df, ["card_id"], ["ts", "seq"], active, gap_seconds=3 * 3600.0, tail_seconds=1200.0)
    assert run(lambda s: twins.stream_mask_sessions(s, active, "3 hours", 1200.0), "masks") == sorted(map(tuple, masks.collect()))

    runs = series.threshold_runs(df, ["card_id"], ["ts", "seq"]).select("card_id", "start_ts", "end_ts", "n_samples", "peak")
    assert run(twins.stream_episodes, "runs") == sorted(map(tuple, runs.collect()))


def test_a_cluster_must_name_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert checkpoint_dir(Session()) == checkpoint_dir(Session())


def test_value_maps_repeated_keys_and_texts_without_a_number(spark):
    files = spark.createDataFrame(
        [(1, "Press=8\npress=9\nPRESS =10\nMax_Leak: n/a\nmax leak: 1,200\nLeak Avg=.5"), (2, "mode: CPAP\nset pressure: 850 (fixed)")], "f int, text string"
    )
    maps = text.value_maps(text.key_values(files, ["f"]), ["f"])
    got = {r.f: r for r in maps.collect()}
    assert {k: v.number for k, v in got[1].exact.items()}.items() >= {"Press": 8.0, "press": 9.0, "PRESS": 10.0, "Max_Leak": None, "max leak": 1200.0}.items()
    assert (got[1].lower["press"].value, got[1].compact["press"].value) == ("10", "10")
    assert (got[1].lower["max_leak"].value, got[1].compact["maxleak"].number) == ("n/a", 1200.0)
    assert [e.lower for e in got[1].entries if "leak" in e.lower][:3] == ["max_leak", "max leak", "leak avg"]
    day = {r.f: r for r in text.daily_records(maps).collect()}
    assert (day[1].leak, day[1].leak_max, day[1].settings_machine.pressure) == (0.5, None, "Fixed 8 cmH2O")
    read = settings.with_settings(maps).where("f = 2").select("set_mode", "set_pressure", "set_ramp_time").first()
    assert tuple(read) == ("CPAP", "8.5 cmH2O", None)


def test_settings_parse_a_number_once(spark):
    """The plan held a copy of every parse for every use of its number: over 400 for the settings of one map."""
    files = spark.createDataFrame([(1, "Press=8")], "f int, text string")
    maps = text.value_maps(text.key_values(files, ["f"]), ["f"])
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        plan = settings.with_settings(maps)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("regexp_extract") < 50


def test_paths_are_searched_before_they_are_matched(spark):
    """F8, F10, F19 to F21: patterns are tried only where their text is there, and nothing is missed."""
    import re

    from noonday.functions import family_rules as fr

    every = {f.id: f.signature + f.priority + tuple(p for p, _ in f.confidence) for f in fr.FAMILIES}
    every |= {"always": fr.KEEP_ALWAYS, "base": fr.BASE_PRIORITY, "pinned": catalogue.PINNED} | {f"keep {k}": v for k, v in fr.KEEP_BY_FAMILY.items()}
    parts = ["Therapy", "RECORD", "202401", "05", "stat", "Stat12.txt", "EV01", "p01_5.x", "Config", "datalog", "STR.edf.gz", "eve.EDF", "identification.JSON", "settings", "a.log", "summary.csv",
             "fphcare", "icon", "X1", "sum1.fph", "flw.FPH", "realtime", "hrd1.edf", "config.pscfg", "Therapy.pdat", "event_1.xml", "signal_.wmedf", "wm_data.tdf", "P-Series", "p12345.001",
             "prop.bin", "M-SERIES", "therapy.dat", "b1.usr", "b1.IDX", "b1.000", "b.evt", "SL", "set1", "u", "dv6", "set.bin", "s.bin", "yhsd-new.bys", "sn.bys", "yh1", "dreem1.csv", "viatom", "Oximeter",
             "vrem7", "pi.txt", "DI.txt", "od1", "spo2.dat", "cms50f37", "a.spo", "xmd300.dat", "medview.dat", "somnopose.csv", "zeosleep", "profile", "\u0130con", "str\nx.edf"]
    dice = random.Random(3)
    paths = parts + ["/".join(dice.choices(parts, k=dice.randint(2, 4))) for _ in range(1500)]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    both = frame.select("path", *[F.struct(catalogue.fits("path", p).alias("new"), F.col("path").rlike(fr.any_of(p)).alias("old")).alias(n) for n, p in every.items()])
    for row in both.collect():
        assert all(row[n].new == row[n].old for n in every), row
    for pattern in {p for ps in every.values() for p in ps}:
        texts = fr.needed_texts(pattern)
        assert all(not re.search("(?i)" + pattern, p) or not texts or any(t in p.lower() for t in texts) for p in paths), pattern
    assert fr.needed_texts(r"(?:^|/)datalog/.*/str\.edf(?:\.gz)?$") and fr.needed_texts(r"(?:^|/).*\.(?:dat)$") == (".dat",)
    assert fr.needed_texts("(?:^|/)(?:viatom|oximeter)") == ("viatom", "oximeter") and fr.needed_texts("a|bc") == ()


def test_settings_json_is_parsed_once(spark):
    body = '{"FlowGenerator":{"SettingProfiles":{"ActiveProfiles":{"TherapyProfile":"A"},"TherapyProfiles":{"A":{"TherapyMode":"CPAP","SetPressure":9}}}}}'
    files = spark.createDataFrame([(1, body), (2, "{}"), (3, None)], "file_id long, text string").repartition(2)
    read = text.json_settings(files, ["file_id"])
    assert read._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
    assert [(r.file_id, r.mode, r.pressure) for r in read.collect()] == [(1, "CPAP", "Fixed 9 cmH2O")]
