"""Record and session cleaning: value ranges, validity, duplicates, unions and day sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day, micros
from noonday.operators.tracks import by_hour, islands
from noonday.sources.sinks import keep

# The range of each measured field.  (low, low is allowed, high, high is allowed)
USAGE = (0, True, 24, True)
RATE = (0, True, 200, False)
LEAK = (0, True, 500, False)
MINUTES = (0, True, None, False)
PRESSURE = (0, False, 80, True)
RESPIRATORY_RATE = (0, False, 120, True)
TIDAL_VOLUME = (0, False, 5, True)
FIELD_RANGES = {
    "usage_hours": USAGE,
    "ahi": RATE, "residual_apneas": RATE, "central_apneas": RATE, "rera_index": RATE,
    "leak": LEAK, "leak_95": LEAK, "leak_max": LEAK, "leak_max_30m": LEAK, "leak_max_60m": LEAK,
    "max_leak_minutes": MINUTES, "sustained_leak_max": LEAK, "sustained_leak_minutes": MINUTES,
    "pressure_avg": PRESSURE, "pressure_95": PRESSURE, "ipap_avg": PRESSURE, "ipap_95": PRESSURE,
    "epap_avg": PRESSURE, "epap_95": PRESSURE,
    "vt_avg": TIDAL_VOLUME, "vt_min": TIDAL_VOLUME, "vt_median": TIDAL_VOLUME, "vt_max": TIDAL_VOLUME,
    "rr_avg": RESPIRATORY_RATE, "rr_min": RESPIRATORY_RATE, "rr_95": RESPIRATORY_RATE,
}
# Columns that tell two records apart, besides the calendar date and the settings signature.
SIGNATURE_FIELDS = [*FIELD_RANGES, "max_leak_duration_value", "vt_samples", "rr_samples"]
DAY_SECONDS = 24 * 3600


def in_range(c: Column | str, bounds: tuple) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    low, low_ok, high, high_ok = bounds
    test = value >= low if low_ok else value > low
    if high is not None:
        test = test & (value <= high if high_ok else value < high)
    return test & ~F.isnan(value)


def ranged(c: Column | str, bounds: tuple) -> Column:
    """The value if it lies in its range, else NULL."""
    value = F.col(c) if isinstance(c, str) else c
    return F.when(in_range(value, bounds), value)


def _present(df: DataFrame) -> list[str]:
    return [c for c in FIELD_RANGES if c in df.columns]


def with_signal(records: DataFrame) -> DataFrame:
    """Keep a record if any of its metrics lies in its range."""
    tests = [F.coalesce(in_range(c, FIELD_RANGES[c]), F.lit(False)) for c in _present(records)]
    return records.where(reduce(or_, tests))


def clip_fields(records: DataFrame) -> DataFrame:
    """NULL out single fields that lie outside their range; the row stays."""
    return records.withColumns({c: ranged(c, FIELD_RANGES[c]) for c in _present(records)})


def valid_sessions(sessions: DataFrame) -> DataFrame:
    """Both ends present, end after start, at most 24 hours."""
    length = micros("end_ts") - micros("start_ts")
    return sessions.where((length > 0) & (length <= DAY_SECONDS * 1_000_000))


def sessions_in_period(sessions: DataFrame, periods: DataFrame) -> DataFrame:
    """Sessions of a settings period: by their source day if they have one, else by clinical or calendar start day.

    ``periods`` holds at most a few rows per card.
    """
    first, last = F.col("period_start"), F.col("period_end")
    start = F.col("start_ts")
    source = F.col("source_clinical_day")
    by_start = clinical_day(start).between(first, last) | F.to_date(start).between(first, last)
    return sessions.join(periods, "card_id").where(
        F.when(source.isNotNull(), source.between(first, last)).otherwise(by_start)
    )


def period_sessions(sessions: DataFrame, periods: DataFrame) -> DataFrame:
    """Sessions by card and ``kind`` of settings period; a card without any period has them all in its current one.

    A session in the calendar day of one period and the clinical day of the other belongs to both.
    """
    bounds = periods.select("card_id", "kind", "period_start", "period_end")
    own = sessions_in_period(sessions, bounds).drop("period_start", "period_end")
    rest = sessions.join(periods.select("card_id").distinct(), "card_id", "left_anti").withColumn("kind", F.lit("current"))
    return own.unionByName(rest)


def distinct_sessions(sessions: DataFrame, keys: Sequence[str] = ("card_id",)) -> DataFrame:
    """One row per (card, start, end)."""
    return sessions.select(*keys, "start_ts", "end_ts").distinct()


def distinct_records(records: DataFrame, order: str = "seq") -> DataFrame:
    """First record per calendar date, metrics to three decimals and settings signature.

    A min-by aggregate instead of a ranking window: duplicates fold together before the shuffle, so a date with very
    many copies costs one row per task.
    """
    keys = [F.to_date("date").alias("__date")]
    keys += [F.round(c, 3).alias(f"__{c}") for c in SIGNATURE_FIELDS if c in records.columns]
    keys.append(F.coalesce("settings_signature", F.lit("")).alias("__sig"))
    row = F.struct(*records.columns)
    return (
        records.groupBy("card_id", *keys)
        .agg(F.min_by(row, order).alias("__row"), F.count(F.lit(1)).alias("copies"))
        .select("__row.*", "copies")
    )


def union_records(*parts: DataFrame) -> DataFrame:
    """Records of several sources; a source without a column gives NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def days_in_both(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("card_id", "clinical_day")) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def days_only_in(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("card_id", "clinical_day")) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def first_available_day(days: DataFrame, history: DataFrame) -> DataFrame:
    """Earliest day per card over day rows and declared history starts."""
    known = days.select("card_id", "clinical_day").unionByName(
        history.select("card_id", F.col("history_start").alias("clinical_day"))
    )
    return known.groupBy("card_id").agg(
        F.min("clinical_day").alias("first_day"), F.countDistinct("clinical_day").alias("n_days")
    )


def fuzzy_distinct_sessions(sessions: DataFrame, minutes: int = 2, keys: Sequence[str] = ("card_id",)) -> DataFrame:
    """Walk the sessions of a card (or of further ``keys``) by start, end and drop one if a kept one has both ends within
    ``minutes``.

    Only sessions whose starts chain together within the tolerance can drop each other, so a card is cut wherever two
    starts lie further apart.  Exact copies are folded before anything is ordered, and most clusters then hold one
    session, which is kept as it is.  A cluster is walked by the hours of its starts, each hour on its own: what the hours
    before can change are the sessions kept in their last ``minutes``.  All hours are walked from nothing first, then again
    from what the hour before has kept, until that no longer changes.  Walks that begin apart meet at the first session that
    both keep, so a few rounds do unless a chain is regular to the second; no task walks more than an hour of a card.
    """
    near, keys = minutes * 60 * 1_000_000, list(keys)
    rows = islands(
        distinct_sessions(sessions, keys),
        by_hour(keys, ["start_ts", "end_ts"]),
        {"s": micros("start_ts")},
        lambda prev, now: now["s"] - prev["s"] > near,
        "__cluster",
    ).drop("at")
    group = [*keys, "__cluster"]
    rows = keep(rows.select(*group, "start_ts", "end_ts", micros("start_ts").alias("__s"), micros("end_ts").alias("__e"), F.expr(f"unix_micros(start_ts) div {HOUR}").alias("__hour")), "clusters")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), (F.min("__hour") != F.max("__hour")).alias("__long"))
    sized = rows.join(sizes.where("__n > 1"), group, "left")
    alone = sized.where("__n IS NULL").select(*keys, "start_ts", "end_ts")
    # the sessions kept just before an hour, as its rows carry them
    nothing = F.lit(None).cast("array<struct<s:bigint,e:bigint>>").alias("__carry")
    short = _walked(sized.where("NOT __long").select(*rows.columns, nothing), group, near)
    long = keep(sized.where("__long").select(*rows.columns), "long-clusters")
    found = alone.unionByName(short.select(*keys, "start_ts", "end_ts"))
    if long.isEmpty():
        return found
    last, state = None, long.select(*group, "__hour", nothing).limit(0)
    while True:
        walked = keep(_walked(long.join(state, [*group, "__hour"], "left"), group, near), "walked")
        ends = walked.where(F.col("__s") >= (F.col("__hour") + 1) * HOUR - near)
        carry = F.array_sort(F.collect_list(F.struct(F.col("__s").alias("s"), F.col("__e").alias("e")))).alias("__carry")
        state = keep(ends.groupBy(*group, (F.col("__hour") + 1).alias("__hour")).agg(carry), "carried")
        marks = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*state.columns)), F.bit_xor(F.xxhash64(F.lit(7), *state.columns))).first()
        if marks == last:
            return found.unionByName(walked.select(*keys, "start_ts", "end_ts"))
        last = marks


HOUR = 3_600_000_000


def _walked(rows: DataFrame, group: Sequence[str], near: int) -> DataFrame:
    """The rows that a walk of every hour of every group keeps."""
    hour = [*group, "__hour"]
    dealt = rows.repartition(*hour).sortWithinPartitions(*hour, "start_ts", "end_ts")
    return dealt.mapInPandas(lambda batches: _greedy_walk(batches, near, hour), rows.schema)


def _greedy_walk(batches: Iterator[pd.DataFrame], near: int, hour: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Keep a row unless a kept row of its hour, or one carried into it, starts at most ``near`` earlier and ends within it."""
    at, recent = None, []
    for batch in batches:
        keep_rows = []
        groups = zip(*(batch[k] for k in hour), strict=True)
        for key, start, end, carry in zip(groups, batch["__s"], batch["__e"], batch["__carry"], strict=True):
            if key != at:
                at, recent = key, [] if carry is None else [(x["s"], x["e"]) for x in carry]
            recent = [(s, e) for s, e in recent if start - s <= near]
            fresh = not any(abs(end - e) <= near for _, e in recent)
            if fresh:
                recent.append((start, end))
            keep_rows.append(fresh)
        yield batch[keep_rows]
