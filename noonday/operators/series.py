"""Sample series: islands, rolling averages, threshold episodes, mask sessions, marker pairs, carry-forward.

Rows may come from cards of any size.  Islands are found with the chunked scans of :mod:`noonday.operators.tracks`
and reduced with ordinary aggregates, so no task holds a card.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonday.functions.dates import micros, seconds_between, shift_seconds
from noonday.operators.tracks import Track, by_day, islands, moving_averages, previous, running

# Fixed values.
LARGE_LEAK_LPM = 30.0
MAX_STEP_SECONDS = 2.0
MASK_GAP_SECONDS = 5.0
INACTIVE_TAIL_SECONDS = 300.0


def track_of(keys: Sequence[str], order: Sequence[str]) -> Track:
    return by_day(keys, order)


def drop_repeated_stamps(samples: DataFrame, keys: Sequence[str], ts: str = "ts", tie: str = "seq") -> DataFrame:
    """First sample per (keys, timestamp)."""
    row = F.struct(*samples.columns)
    return samples.groupBy(*keys, ts).agg(F.min_by(row, tie).alias("__r")).select("__r.*")


def reset_islands(
    samples: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    valid: Column,
    max_step_seconds: float | None = MAX_STEP_SECONDS,
) -> DataFrame:
    """Valid samples with ``island`` (place of its first row) and ``pos`` (1-based place in the island).

    An invalid sample, or a step longer than ``max_step_seconds``, closes the island before it.
    """

    def opens(prev: Column, now: Column) -> Column:
        closed = ~prev["ok"]
        if max_step_seconds is not None:
            closed = closed | (now["t"] - prev["t"] > int(max_step_seconds * 1_000_000))
        return closed

    ok = F.coalesce(valid, F.lit(False))
    cut = islands(samples, track_of(keys, order), {"ok": ok, "t": micros(order[0])}, opens)
    return cut.where(ok).withColumn("pos", F.col("at") - F.col("island") + 1).drop("at")


def rolling_maxima(
    islands: DataFrame, track_keys: Sequence[str], keys: Sequence[str], value: str, windows: dict[str, int]
) -> DataFrame:
    """Largest average over ``size`` consecutive samples per key; windows never cross an island border.

    ``track_keys`` are the keys the islands were found under.  ``keys`` may add columns that change inside an island
    (the clinical day): a window belongs to the key of its last sample.  Windows that are not full give nothing.
    """
    averaged = moving_averages(islands, [*track_keys, "island"], "pos", value, windows)
    return averaged.groupBy(*keys).agg(*[F.max(name).alias(name) for name in windows]).where(
        F.coalesce(*windows).isNotNull()
    )


def threshold_runs(
    samples: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str = "value",
    seconds: str = "sample_seconds",
    threshold: float = LARGE_LEAK_LPM,
    valid: Column | None = None,
    max_step_seconds: float | None = None,
) -> DataFrame:
    """Maximal runs of samples above the threshold: start, sample count, duration and peak."""
    above = F.col(value) > threshold
    if valid is not None:
        above = above & valid
    above = F.coalesce(above, F.lit(False))

    def opens(prev: Column, now: Column) -> Column:
        changed = prev["above"] != now["above"]
        if max_step_seconds is not None:
            changed = changed | (now["t"] - prev["t"] > int(max_step_seconds * 1_000_000))
        return changed

    cut = islands(samples, track_of(keys, order), {"above": above, "t": micros(order[0])}, opens, "run")
    return (
        cut.where(above)
        .groupBy(*keys, "run")
        .agg(
            F.min(order[0]).alias("start_ts"),
            F.max(order[0]).alias("end_ts"),
            F.count(F.lit(1)).alias("n_samples"),
            (F.sum(seconds) / 60).alias("minutes"),
            F.max(value).alias("peak"),
        )
        .drop("run")
    )


def best_episodes(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Longest run (on a tie the higher peak) and highest-peak run (on a tie the longer)."""
    longest = F.max(F.struct("minutes", "peak"))
    highest = F.max(F.struct("peak", "minutes"))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), longest.alias("l"), highest.alias("h")
    ).select(
        *keys, "n_runs",
        F.col("l.minutes").alias("longest_minutes"), F.col("l.peak").alias("longest_leak"),
        F.col("h.peak").alias("max_leak"), F.col("h.minutes").alias("max_leak_minutes"),
    )


def mask_sessions(
    samples: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    active: Column,
    gap_seconds: float = MASK_GAP_SECONDS,
    tail_seconds: float = INACTIVE_TAIL_SECONDS,
) -> DataFrame:
    """Mask-on sessions: a gap splits; a long inactive tail ends the session at its last active sample."""
    ts = order[0]
    gap = int(gap_seconds * 1_000_000)
    cut = islands(
        samples.withColumn("__active", active), track_of(keys, order), {"t": micros(ts)},
        lambda prev, now: now["t"] - prev["t"] >= gap, "session",
    )
    grouped = cut.groupBy(*keys, "session").agg(
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("last_ts"),
        F.max(F.when(F.col("__active"), F.col(ts))).alias("last_active"),
        F.count(F.lit(1)).alias("n_samples"),
    )
    by_tail = seconds_between("last_active", "last_ts") >= tail_seconds
    end = F.when(by_tail, F.col("last_active")).otherwise(shift_seconds("last_ts", 1))
    return grouped.where(F.col("last_active").isNotNull()).select(
        *keys, "start_ts", end.alias("end_ts"), "n_samples"
    )


def on_off_slices(markers: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str, is_on: Column) -> DataFrame:
    """Usage slices from delta-coded markers: each "off" right after an "on" closes a slice.

    Times are cumulative deltas in seconds.  An "off" without an "on" is ignored, a second "on" replaces the first.
    """
    track = track_of(keys, order)
    clock = running(markers.withColumn("__on", is_on), track, {"at": ("sum", delta)})
    with_prev = previous(clock, track, {"from_at": "at", "__was_on": "__on"})
    return with_prev.where(~F.col("__on") & F.col("__was_on")).select(
        *keys, *order, "from_at", F.col("at").alias("to_at"), (F.col("at") - F.col("from_at")).alias("used")
    )


def carry_forward(frames: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Last known value at every frame; frames before the first value are dropped."""
    carried = running(frames, track_of(keys, order), {name: ("last", value)})
    return carried.where(F.col(name).isNotNull())


def natural_key(path: Column | str) -> Column:
    """Text that sorts like the path with its runs of digits compared by value; case decides only through the path itself.

    A run becomes its digits without leading zeros behind their number, so longer numbers sort after shorter ones.
    """
    runs = F.regexp_extract_all(F.lower(path), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    keyed = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(r)).cast("string"), 4, "0"), digits(r))).otherwise(r))
    return F.array_join(keyed, "")


def newest_by_path(files: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """The last path of each group in natural order (``newest``), in lexical order (``last``), and the number of paths."""
    return files.groupBy(*keys).agg(
        F.max_by(path, F.struct(natural_key(path), F.col(path))).alias("newest"), F.max(path).alias("last"), F.count(F.lit(1)).alias("n")
    )
