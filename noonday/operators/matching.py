"""Joins of samples, events, markers and files with sessions, days and each other."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day, micros, seconds_between, shift_minutes
from noonday.operators.rollup import hourly
from noonday.operators.tracks import by_block, by_day, by_hour, numbered, running

DAY_SECONDS = 24 * 3600
MIN_HINT_SHARE = 0.8


# --- equi joins that fill values -------------------------------------------------------------------------------


def override_ahi(sessions: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Event-derived AHI replaces the summary AHI where events were counted and the usage is positive.

    ``events`` is one row per key (``event_count``).
    """
    use = (F.col("event_count") > 0) & (F.col("usage_hours") > 0)
    return (
        sessions.join(events.select(*keys, "event_count"), list(keys), "left")
        .withColumn("ahi", F.when(use, F.col("event_count") / F.col("usage_hours")).otherwise(F.col("ahi")))
        .drop("event_count")
    )


def fill_from_events(records: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Apnea index from daily event counts where missing; the central index only if every apnea is classified.

    ``events``: keys, apneas, centrals, obstructives.
    """
    joined = records.join(events, list(keys), "left")
    classified = (F.col("centrals") + F.col("obstructives") > 0) & (
        F.col("apneas") == F.col("centrals") + F.col("obstructives")
    )
    return joined.withColumns(
        {
            "residual_apneas": F.coalesce("residual_apneas", hourly("apneas", "usage_hours")),
            "central_apneas": F.coalesce("central_apneas", F.when(classified, hourly("centrals", "usage_hours"))),
        }
    ).drop("apneas", "centrals", "obstructives")


def fill_missing_days(summary: DataFrame, samples: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Sample-derived day rows only for days whose summary has no value."""
    known = summary.where(F.col(value).isNotNull()).select(*keys, value)
    extra = samples.select(*keys, value).join(known.select(*keys), list(keys), "left_anti")
    return known.withColumn("source", F.lit("summary")).unionByName(extra.withColumn("source", F.lit("samples")))


# --- interval and nearest matching -----------------------------------------------------------------------------


def ownership(sessions: DataFrame) -> DataFrame:
    """Disjoint spans in which each session is the earliest-starting one that has not ended.

    A session owns its time after the latest end of all sessions that start before it.  Sessions that are covered
    entirely own nothing and drop out, so a moment has at most one owner however many sessions overlap.
    """
    track = by_day(["card_id"], ["start_ts", "end_ts"])
    seen = running(sessions, track, {"__until": ("max", "end_ts")}, inclusive=False)
    return seen.where(F.col("__until").isNull() | (F.col("end_ts") > F.col("__until"))).select(
        "card_id", "start_ts", "end_ts",
        F.greatest(micros("start_ts"), micros("__until") + 1).alias("own_from"),
        micros("end_ts").alias("own_to"),
    )


def assign_to_sessions(samples: DataFrame, sessions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Samples with the session whose closed interval holds them; the earliest-starting one still running wins.

    An as-of match: spans and samples are merged into one ordered track and the last span start is carried forward.
    Nothing is paired, so overlaps and busy cards cost no more than their rows.
    """
    spans = ownership(sessions).select(
        "card_id",
        F.col("own_from").alias("__at"),
        F.lit(0).alias("__side"),
        F.struct("start_ts", "end_ts", "own_to").alias("__span"),
        *[F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in columns],
    )
    points = samples.select(
        "card_id",
        micros("ts").alias("__at"),
        F.lit(1).alias("__side"),
        F.lit(None).cast(spans.schema["__span"].dataType).alias("__span"),
        *columns,
    )
    merged = spans.unionByName(points).withColumn("__time", F.timestamp_micros("__at"))
    track = by_day(["card_id"], ["__time", "__side"])
    carried = running(merged, track, {"__owner": ("last", "__span")})
    return carried.where((F.col("__side") == 1) & (F.col("__at") <= F.col("__owner.own_to"))).select(
        "card_id", *columns, F.col("__owner.start_ts").alias("start_ts"), F.col("__owner.end_ts").alias("end_ts")
    )


#: Sizes of the chunks of offsets that slices are swept in; a slice belongs to the smallest size that is not below its length.
CHUNK_SIZES = tuple(1 << n for n in (16, 24, 32, 40, 48, 62))


def _owners(columns: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Disjoint spans, each owned by the least slice number over it, from slices sorted by chunk and start.

    The state is the slices that are open and can still become the owner: in the order of their numbers each one ends after
    those before it.  A chunk streams through in batches, so it may hold any number of slices.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, open_, at = None, [], 0  # open_: (number, end), both rising

        def upto(stop: int | None, out: list[tuple]) -> None:
            nonlocal at
            while open_ and (stop is None or at < stop):
                owner, end = open_[0]
                until = end if stop is None else min(end, stop)
                if until > at:
                    out.append((*chunk, at, until, owner))
                    at = until
                if end <= at:
                    open_.pop(0)

        for batch in batches:
            out: list[tuple] = []
            keys = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            rows = zip(keys, *(batch.column(c).to_pylist() for c in ("from_offset", "to_offset", "slice_no")), strict=True)
            for key, start, end, number in rows:
                if key != chunk:
                    upto(None, out)
                    chunk, open_, at = key, [], start
                upto(start, out)
                at = max(at, start)
                place = bisect_left(open_, (number, 0))
                if place and open_[place - 1][1] >= end:
                    continue
                drop = place
                while drop < len(open_) and open_[drop][1] <= end:
                    drop += 1
                open_[place:drop] = [(number, end)]
            if out:
                yield _spans(out, batch, columns)
        if open_:
            out = []
            upto(None, out)
            yield _spans(out, batch, columns)

    return sweep


def _spans(out: list[tuple], batch: pa.RecordBatch, columns: Sequence[str]) -> pa.RecordBatch:
    names = [*columns, "from_offset", "to_offset", "slice_no"]
    return pa.record_batch([pa.array(v, batch.schema.field(n).type) for n, v in zip(names, zip(*out, strict=True), strict=True)], names=names)


def _leveled(slices: DataFrame, keys: Sequence[str], record_size: int) -> DataFrame:
    """Slices that hold an offset, ``from_offset`` floored to the record size, with the level and chunk size of their length."""
    start = (F.floor(F.col("from_offset") / record_size) * record_size).cast("bigint")
    named = slices.select(*keys, start.alias("from_offset"), F.col("to_offset").cast("bigint"), F.col("slice_no").cast("bigint")).where("to_offset > from_offset")
    length = F.col("to_offset") - F.col("from_offset")
    fits = [F.when(length <= size, F.struct(F.lit(n).alias("level"), F.lit(size).alias("size"))) for n, size in enumerate(CHUNK_SIZES)]
    return named.withColumn("fit", F.coalesce(*fits))


def slice_spans(slices: DataFrame, keys: Sequence[str], record_size: int = 1) -> DataFrame:
    """``keys``, ``level``, ``from_offset``, ``to_offset``, ``slice_no``: disjoint spans of each level, owned by the first slice.

    The level is that of the slice's chunk size, so a slice lies in at most two chunks and is at most two rows, however
    long it is.
    """
    chunks = F.sequence(F.expr("from_offset div fit.size"), F.expr("(to_offset - 1) div fit.size"))
    sized = _leveled(slices, keys, record_size).withColumn("chunk", F.explode(chunks))
    cut = sized.select(
        *keys, "fit.level", "chunk", F.greatest("from_offset", F.col("chunk") * F.col("fit.size")).alias("from_offset"),
        # written so that the end of the last chunk cannot overflow
        (F.least(F.col("to_offset") - 1, F.col("chunk") * F.col("fit.size") + (F.col("fit.size") - 1)) + 1).alias("to_offset"), "slice_no",
    )
    chunk = [*keys, "level", "chunk"]
    dealt = cut.repartition(*chunk).sortWithinPartitions(*chunk, "from_offset", "slice_no")
    return dealt.mapInArrow(_owners(chunk), cut.schema).drop("chunk")


def assign_to_slices(
    records: DataFrame, slices: DataFrame, keys: Sequence[str], record_id: str, record_size: int = 1
) -> DataFrame:
    """Records whose offset lies in ``[from_offset, to_offset)`` of an index row; the first index row wins.

    Slices are swept into disjoint spans of an owner; spans and records are then merged into one track by offset, in which
    a record looks back to the last span of each level.  A record is one row from end to end.
    """
    spans = slice_spans(slices, keys, record_size)
    # the levels in use, at most one for each chunk size
    levels = sorted(r["level"] for r in _leveled(slices, keys, record_size).select("fit.level").distinct().collect())
    none = F.lit(None).cast("struct<until:bigint,slice_no:bigint>")
    own = F.struct(F.col("to_offset").alias("until"), "slice_no")
    owners = spans.select(
        *keys, F.col("from_offset").alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(records.schema[record_id].dataType).alias(record_id),
        *[F.when(F.col("level") == n, own).otherwise(none).alias(f"__level{n}") for n in levels],
    )
    points = records.select(*keys, F.col("offset").cast("bigint").alias("__at"), F.lit(1).alias("__side"), record_id, *[none.alias(f"__level{n}") for n in levels])
    track = by_block(keys, ["__at", "__side"], CHUNK_SIZES[0])
    carried = running(owners.unionByName(points), track, {f"__own{n}": ("last", f"__level{n}") for n in levels}).where("__side = 1")
    of_level = [F.when(F.col("__at") < F.col(f"__own{n}.until"), F.col(f"__own{n}.slice_no")) for n in levels] or [F.lit(None).cast("bigint")]
    first = of_level[0] if len(of_level) == 1 else F.least(*of_level)
    return carried.select(*keys, record_id, first.alias("slice_no")).where("slice_no IS NOT NULL")


def assign_to_nearest_day(points: DataFrame, days: DataFrame, point_id: str) -> DataFrame:
    """Points outside every slice go to the nearest noon-to-noon day among the eligible days of their card.

    A day is eligible from its midnight to its noon plus usage (one hour if unknown) plus 12 hours, or if it is at most
    one calendar day apart.  With usage up to 24 hours that is at most four dates, so a point is tried on four dates and
    matched by equality; ties go to the earlier day.
    """
    date = F.to_date("ts")
    tried = points.withColumn("day", F.explode(F.array(*[F.date_add(date, n) for n in (-2, -1, 0, 1)])))
    joined = tried.join(days.select("card_id", "day", "usage_hours"), ["card_id", "day"])
    midnight = F.col("day").cast("timestamp")
    noon = shift_minutes(midnight, 720)
    until = F.timestamp_micros(
        micros(noon) + ((F.coalesce("usage_hours", F.lit(1.0)) + 12) * 3_600_000_000).cast("bigint")
    )
    eligible = F.col("ts").between(midnight, until) | (F.abs(F.datediff(date, F.col("day"))) <= 1)
    distance = F.greatest(
        F.lit(0.0), seconds_between("ts", noon), seconds_between(shift_minutes(noon, 1440), "ts")
    )
    best = F.min(F.struct(distance.alias("distance"), F.col("day")))
    return (
        joined.where(eligible)
        .groupBy("card_id", point_id)
        .agg(best.alias("b"))
        .select("card_id", point_id, "b.day", F.col("b.distance").alias("distance_seconds"))
    )


def pair_markers(markers: DataFrame, keys: Sequence[str], order: Sequence[str], is_start: Column) -> DataFrame:
    """k-th start marker with the k-th end marker of a group; the group drops out unless it sums to 0-24 hours."""
    split = markers.withColumn("__start", is_start)
    track = by_hour([*keys, "__start"], order)
    placed = numbered(split, track, "ordinal")
    starts = placed.where("__start").select(*keys, "ordinal", F.col("ts").alias("start_ts"))
    ends = placed.where("NOT __start").select(*keys, "ordinal", F.col("ts").alias("end_ts"))
    seconds = seconds_between("start_ts", "end_ts")
    pairs = (
        starts.join(ends, [*keys, "ordinal"])
        .withColumn("seconds", seconds)
        .where((F.col("seconds") > 0) & (F.col("seconds") <= DAY_SECONDS))
    )
    totals = pairs.groupBy(*keys).agg(F.sum("seconds").alias("total_seconds"))
    return pairs.join(totals.where(F.col("total_seconds") <= DAY_SECONDS), list(keys))


def pair_files(files: DataFrame, left: Column, right: Column) -> DataFrame:
    """Summary file with the minute file of the same directory (first by path on each side)."""
    directory = F.regexp_replace("path", r"[^/]*$", "")
    placed = files.withColumn("directory", directory)
    pick = lambda test: F.min(F.when(test, F.col("path")))
    return (
        placed.where(left | right)
        .groupBy("card_id", "directory")
        .agg(pick(left).alias("summary_path"), pick(right).alias("minute_path"))
        .where(F.col("summary_path").isNotNull() & F.col("minute_path").isNotNull())
    )


# --- semi joins ------------------------------------------------------------------------------------------------


def recent_sessions(sessions: DataFrame, days: int) -> DataFrame:
    """Sessions of the last ``days`` clinical days before and including the card's newest one."""
    dated = sessions.withColumn("__day", clinical_day("start_ts"))
    newest = dated.groupBy("card_id").agg(F.max("__day").alias("__newest"))
    return (
        dated.join(newest, "card_id")
        .where(F.col("__day") >= F.date_sub("__newest", days - 1))
        .drop("__day", "__newest")
    )


def events_of_sessions(events: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Events of the wanted sessions only, read after the sessions are known."""
    return events.join(sessions.select("card_id", key).distinct(), ["card_id", key], "left_semi")


def trusted_hints(files: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Cards whose path hints name known sessions for at least 80 percent of the hinted files."""
    hinted = files.where(F.col("hint").isNotNull()).groupBy("card_id", "hint").agg(F.count(F.lit(1)).alias("n"))
    known = sessions.select("card_id", F.col(key).alias("hint")).distinct().withColumn("known", F.lit(True))
    joined = hinted.join(known, ["card_id", "hint"], "left")
    hit = F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))
    return joined.groupBy("card_id").agg(
        F.sum("n").alias("hinted"),
        hit.alias("matched"),
        ((hit > 0) & (hit / F.sum("n") >= MIN_HINT_SHARE)).alias("trusted"),
    )


def restrict_to_days(samples: DataFrame, days: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.join(days.select(*keys).distinct(), list(keys), "left_semi")


def choose_root(roots: DataFrame, pointers: DataFrame) -> DataFrame:
    """Active root per card: the one a pointer names if it holds data, else the best by weighted counts.

    ``roots``: card_id, root, files, binaries, data_files, metadata.  ``pointers``: card_id, seq, root.
    """
    score = F.col("binaries") * 10000 + F.col("data_files") * 100 + F.col("metadata") * 10 + F.col("files")
    plausible = (F.col("binaries") > 0) | (F.col("data_files") > 0)
    scored = roots.withColumn("score", score).withColumn("plausible", plausible)
    best = scored.groupBy("card_id").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), F.col("first_seen"), "root")).alias("b"),
        F.count(F.lit(1)).alias("n_roots"),
    )
    named = (
        pointers.join(scored.where("plausible").select("card_id", "root"), ["card_id", "root"])
        .groupBy("card_id")
        .agg(F.min_by("root", "seq").alias("named"))
    )
    return best.join(named, "card_id", "left").select(
        "card_id", "n_roots",
        F.when(F.col("n_roots") == 1, F.col("b.root")).otherwise(F.coalesce("named", "b.root")).alias("root"),
        ((F.col("n_roots") > 1) & F.col("named").isNotNull()).alias("by_pointer"),
    )


def lookup_codes(df: DataFrame, codes: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Code to label, whatever the size of ``codes``."""
    return df.join(codes.select(*keys, label), list(keys), "left")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt: Column | None = None) -> DataFrame:
    """First ``n`` rows of each group.  With a salt the rows are ranked in shares of the group first."""
    if salt is not None:
        share = Window.partitionBy(*keys, salt).orderBy(*order)
        df = df.withColumn("__rn", F.row_number().over(share)).where(F.col("__rn") <= n).drop("__rn")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n)
