"""Chunked scans against plain windows, with one card that holds most rows, in any input order."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from noonday.operators import series, tracks
from noonday.operators.cleaning import fuzzy_distinct_sessions
from noonday.operators.rollup import exact_percentiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        card = 1 if i % 3 else rng.randint(2, 40)
        rows.append((card, i, 1_700_000_000 + rng.randint(0, 6) * 40_000 + i * 37, float(rng.randint(0, 60)), rng.random() < 0.9))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "card_id long, seq long, t long, value double, ok boolean")
    return df.withColumn("ts", F.timestamp_seconds("t")).drop("t").repartition(5).cache()


KEYS, ORDER = ["card_id"], ["ts", "seq"]


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_positions_previous_running(skewed):
    w = Window.partitionBy("card_id").orderBy("ts", "seq")
    track = tracks.by_hour(KEYS, ORDER)
    same(
        tracks.numbered(skewed, track).select("seq", "pos"),
        skewed.select("seq", F.row_number().over(w).cast("bigint").alias("pos")),
    )
    same(
        tracks.previous(skewed, track, {"p": "value"}).select("seq", "p"),
        skewed.select("seq", F.lag("value").over(w).alias("p")),
    )
    only = F.when(F.col("ok"), F.col("value"))
    got = tracks.running(skewed, track, {"s": ("sum", "value"), "m": ("max", "value"), "l": ("last", only)})
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    same(
        got.select("seq", "s", "m", "l"),
        skewed.select(
            "seq", F.sum("value").over(frame).alias("s"), F.max("value").over(frame).alias("m"),
            F.last(only, ignorenulls=True).over(frame).alias("l"),
        ),
    )


def test_rolling_average_across_blocks(skewed):
    w = Window.partitionBy("card_id").orderBy("ts", "seq")
    placed = tracks.numbered(skewed, tracks.by_day(KEYS, ORDER))
    got = tracks.moving_averages(placed, KEYS, "pos", "value", {"avg": 5}, block_rows=16)
    want = skewed.select(
        "seq",
        F.when(F.row_number().over(w) >= 5, F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 9)).alias("avg"),
    )
    same(got.select("seq", F.round("avg", 9).alias("avg")), want)


def test_long_windows_against_brute_force(spark):
    draw = random.Random(4)
    values = [draw.choice([None, draw.random() * 100]) if i % 50 == 0 else draw.random() * 100 for i in range(9_000)]
    df = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(values)], "card_id long, pos long, value double")
    for block in (2_000, 65_536):
        got = tracks.moving_averages(df, KEYS, "pos", "value", {"a": 1_800, "b": 3_600}, block_rows=block).collect()
        assert len(got) == len(values)
        for r in got[:: 97]:
            for mean, size in ((r.a, 1_800), (r.b, 3_600)):
                inside = [v for v in values[max(0, r.pos - size) : r.pos] if v is not None]
                assert mean is None if r.pos < size else abs(mean - sum(inside) / len(inside)) < 1e-9


def test_islands_against_a_plain_walk(skewed):
    got = series.reset_islands(skewed, KEYS, ORDER, F.col("ok"), 3600.0).select("card_id", "seq", "pos")
    want, state = [], {}
    for r in sorted(skewed.collect(), key=lambda r: (r.card_id, r.ts, r.seq)):
        prev = state.get(r.card_id)
        gap = prev is not None and (r.ts - prev[0]).total_seconds() > 3600
        pos = 1 if prev is None or not prev[1] or gap else prev[2] + 1
        if r.ok:
            want.append((r.card_id, r.seq, pos))
        state[r.card_id] = (r.ts, r.ok, pos if r.ok else 0)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("most", [65_536, 40])
def test_exact_percentiles(skewed, most):
    """Also with a third of all values crowded into a billionth of the range, which takes several rounds."""
    crowd = F.when(F.col("value").cast("long") % 3 == 0, 1e6 + F.rand(5) / 1000).otherwise(F.col("value") * 1e5)
    for table in (skewed, skewed.withColumn("value", crowd).cache()):
        got = exact_percentiles(table, KEYS, "value", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, most)
        want = table.groupBy("card_id").agg(
            *[F.percentile("value", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.0, 0.5, 0.95, 1.0)]
        )
        rounded = lambda d: d.select("card_id", *[F.round(f"p{p}", 6) for p in (0, 50, 95, 100)])
        same(rounded(got), rounded(want))


def test_no_values(skewed):
    assert exact_percentiles(skewed.where("false"), KEYS, "value", {"p50": 0.5}).count() == 0


def test_fuzzy_sessions_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        card = 1 if i % 2 else rng.randint(2, 5)
        start = 1_700_000_000 + rng.randint(0, 30_000)
        rows.append((card, start, start + rng.choice([600, 660, 700, 3600])))
    sessions = spark.createDataFrame(rows, "card_id long, s long, e long").select(
        "card_id", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts")
    )
    got = fuzzy_distinct_sessions(sessions).select("card_id", F.unix_timestamp("start_ts"), F.unix_timestamp("end_ts"))
    want = []
    for card in sorted({r[0] for r in rows}):
        kept = []
        for _, s, e in sorted(r for r in rows if r[0] == card):
            if not any(abs(s - a) <= 120 and abs(e - b) <= 120 for a, b in kept):
                kept.append((s, e))
        want += [(card, s, e) for s, e in kept]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_fuzzy_sessions_of_a_long_chain(spark):
    """Starts that never pause for two minutes over nine hours, so that what is kept depends on hours before."""
    rng, rows, at = random.Random(11), [], 1_700_000_000
    while at < 1_700_000_000 + 9 * 3600:
        rows.append((1, at, at + 4000))
        rows.append((2, at, at + rng.choice([3600, 3660, 3700, 9000])))
        at += rng.choice([60, 61, 90, 119])
    sessions = spark.createDataFrame(rows, "card_id long, s long, e long").select(
        "card_id", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts")
    )
    got = fuzzy_distinct_sessions(sessions).select("card_id", F.unix_timestamp("start_ts"), F.unix_timestamp("end_ts"))
    kept = []
    for row in sorted(set(rows)):
        if not any(k[0] == row[0] and abs(k[1] - row[1]) <= 120 and abs(k[2] - row[2]) <= 120 for k in kept):
            kept.append(row)
    assert sorted(map(tuple, got.collect())) == sorted(kept)
