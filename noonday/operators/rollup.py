"""Day roll-ups, weighted means, pair maxima, histograms and other grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day
from noonday.operators.cleaning import (
    FIELD_RANGES, LEAK, MINUTES, PRESSURE, RATE, RESPIRATORY_RATE, TIDAL_VOLUME, in_range, ranged,
)
from noonday.sources.sinks import keep

DAY = ("card_id", "clinical_day")
SUM_COUNT_FIELDS = [
    "usage_hours", "residual_apneas", "central_apneas", "rera_index", "leak", "leak_95",
    "pressure_avg", "pressure_95", "ipap_avg", "ipap_95", "epap_avg", "epap_95",
]
SAME_LEAK = 0.001


def _mean_parts(field: str) -> list[Column]:
    value = ranged(field, FIELD_RANGES[field])
    return [F.sum(value).alias(f"{field}_sum"), F.count(value).alias(f"{field}_n")]


def ahi_parts() -> list[Column]:
    """AHI weighted by the usage of its record; records without positive usage go to an unweighted fallback."""
    ahi = ranged("ahi", RATE)
    hours = F.when(in_range("usage_hours", FIELD_RANGES["usage_hours"]) & (F.col("usage_hours") > 0),
                   F.col("usage_hours"))
    weighted, plain = F.when(hours.isNotNull(), ahi), F.when(hours.isNull(), ahi)
    return [
        F.sum(weighted * hours).alias("ahi_weighted_sum"),
        F.sum(F.when(weighted.isNotNull(), hours)).alias("ahi_weight_hours"),
        F.sum(plain).alias("ahi_sum"),
        F.count(plain).alias("ahi_n"),
    ]


def ahi_of_day() -> Column:
    return F.coalesce(
        F.when(F.col("ahi_weight_hours") > 0, F.col("ahi_weighted_sum") / F.col("ahi_weight_hours")),
        F.when(F.col("ahi_n") > 0, F.col("ahi_sum") / F.col("ahi_n")),
    )


def sample_weighted_parts(value: str, weight: str, bounds: tuple, name: str) -> list[Column]:
    """Sum and count of means that each stand for ``weight`` samples (1 if the weight is missing)."""
    v = ranged(value, bounds)
    n = F.coalesce(F.when(F.col(weight) > 0, F.col(weight)), F.lit(1.0))
    return [F.sum(v * n).alias(f"{name}_sum"), F.sum(F.when(v.isNotNull(), n)).alias(f"{name}_n")]


def max_leak_pair(leak: Column | str, minutes: Column | str) -> Column:
    """Largest leak with its duration; on equal leak the longer duration, a missing one lowest."""
    return F.max(
        F.when(
            in_range(leak, LEAK),
            F.struct(_c(leak).alias("leak"), F.coalesce(ranged(minutes, MINUTES), F.lit(-1.0)).alias("minutes")),
        )
    )


def longest_leak_pair(leak: Column | str, minutes: Column | str) -> Column:
    """Longest episode; on equal length the higher peak."""
    ok = in_range(leak, LEAK) & in_range(minutes, MINUTES)
    return F.max(F.when(ok, F.struct(_c(minutes).alias("minutes"), _c(leak).alias("leak"))))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_parts(records: DataFrame, *more: Column) -> DataFrame:
    """Mergeable day aggregates: sums, counts, maxima and pair maxima per card and clinical day.

    One aggregation, so Spark combines rows before the shuffle and one row per day and task crosses it.  ``more`` are
    further aggregates to take along in the same pass.
    """
    aggs = [p for f in SUM_COUNT_FIELDS for p in _mean_parts(f)]
    aggs += ahi_parts()
    aggs += sample_weighted_parts("vt_avg", "vt_samples", TIDAL_VOLUME, "vt")
    aggs += sample_weighted_parts("rr_avg", "rr_samples", RESPIRATORY_RATE, "rr")
    aggs += [
        F.min(ranged("vt_min", TIDAL_VOLUME)).alias("vt_min"),
        F.max(ranged("vt_max", TIDAL_VOLUME)).alias("vt_max"),
        F.min(ranged("rr_min", RESPIRATORY_RATE)).alias("rr_min"),
        F.max(ranged("leak_max_30m", LEAK)).alias("leak_max_30m"),
        F.max(ranged("leak_max_60m", LEAK)).alias("leak_max_60m"),
        max_leak_pair("leak_max", "max_leak_minutes").alias("max_leak"),
        longest_leak_pair("sustained_leak_max", "sustained_leak_minutes").alias("sustained"),
        F.count(F.lit(1)).alias("n_records"),
    ]
    return records.groupBy("card_id", clinical_day("date").alias("clinical_day")).agg(*aggs, *more)


_SUMS = [f"{f}_{p}" for f in SUM_COUNT_FIELDS for p in ("sum", "n")] + [
    "ahi_weighted_sum", "ahi_weight_hours", "ahi_sum", "ahi_n", "vt_sum", "vt_n", "rr_sum", "rr_n", "n_records",
]
_MAXIMA = ["vt_max", "leak_max_30m", "leak_max_60m", "max_leak", "sustained"]
_MINIMA = ["vt_min", "rr_min"]


def merge_day_parts(parts: DataFrame) -> DataFrame:
    """Merge day aggregates of several batches of records into one row per day."""
    return parts.groupBy(*DAY).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        *[F.max(c).alias(c) for c in _MAXIMA],
        *[F.min(c).alias(c) for c in _MINIMA],
    )


def approx_equal_minutes(records: DataFrame, days: DataFrame) -> DataFrame:
    """Longest duration of a day's entries whose value is within 0.001 of the day's largest leak."""
    entries = records.select(
        "card_id",
        clinical_day("date").alias("clinical_day"),
        ranged("max_leak_duration_value", LEAK).alias("entry_leak"),
        ranged("max_leak_minutes", MINUTES).alias("entry_minutes"),
    ).where(F.col("entry_leak").isNotNull() & F.col("entry_minutes").isNotNull())
    # One row per distinct value before the join: the join input cannot grow with repeated entries.
    longest = entries.groupBy(*DAY, "entry_leak").agg(F.max("entry_minutes").alias("entry_minutes"))
    return (
        longest.join(days.select(*DAY, F.col("max_leak.leak").alias("day_leak")), list(DAY))
        .where(F.abs(F.col("entry_leak") - F.col("day_leak")) < SAME_LEAK)
        .groupBy(*DAY)
        .agg(F.max("entry_minutes").alias("matched_minutes"))
    )


def finish_days(parts: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Day buckets as the reports read them: flat leak columns, durations completed from near-equal entries."""
    flat = parts.withColumns(
        {
            "leak_max": F.col("max_leak.leak"),
            "max_leak_minutes": F.when(F.col("max_leak.minutes") >= 0, F.col("max_leak.minutes")),
            "sustained_leak_max": F.col("sustained.leak"),
            "sustained_leak_minutes": F.col("sustained.minutes"),
        }
    )
    if records is not None:
        matched = approx_equal_minutes(records, parts)
        flat = flat.join(matched, list(DAY), "left").withColumn(
            "max_leak_minutes", F.greatest("max_leak_minutes", "matched_minutes")
        ).drop("matched_minutes")
    return flat.drop("max_leak", "sustained")


def merge_sample_leak(days: DataFrame, leaks: DataFrame, keep_summary_leak: bool) -> DataFrame:
    """Full outer merge of day aggregates with leak statistics from samples.

    ``leaks``: card_id, clinical_day, mean_leak, max_leak, max_leak_minutes, max_30m, max_60m, longest_leak,
    longest_minutes.  The mean is added unless the summary source already has a leak for the day.
    """
    old = F.struct(F.col("leak_max").alias("leak"), F.coalesce("d.max_leak_minutes", F.lit(-1.0)).alias("minutes"))
    new = F.struct(F.col("max_leak").alias("leak"), F.coalesce("s.max_leak_minutes", F.lit(-1.0)).alias("minutes"))
    old_run = F.struct(F.col("sustained_leak_minutes").alias("minutes"), F.col("sustained_leak_max").alias("leak"))
    new_run = F.struct(F.col("longest_minutes").alias("minutes"), F.col("longest_leak").alias("leak"))
    top = F.greatest(F.when(F.col("leak_max").isNotNull(), old), F.when(F.col("max_leak").isNotNull(), new))
    run = F.greatest(
        F.when(F.col("sustained_leak_minutes").isNotNull(), old_run),
        F.when(F.col("longest_minutes").isNotNull() & F.col("longest_leak").isNotNull(), new_run),
    )
    had = F.coalesce("leak_n", F.lit(0))
    add = F.col("mean_leak").isNotNull() & ~(F.lit(keep_summary_leak) & (had > 0))
    joined = days.alias("d").join(leaks.alias("s"), list(DAY), "full_outer")
    return joined.select(
        *DAY,
        (F.coalesce("leak_sum", F.lit(0.0)) + F.when(add, F.col("mean_leak")).otherwise(0.0)).alias("leak_sum"),
        (had + add.cast("bigint")).alias("leak_n"),
        top["leak"].alias("leak_max"),
        F.when(top["minutes"] >= 0, top["minutes"]).alias("max_leak_minutes"),
        F.greatest("leak_max_30m", "max_30m").alias("leak_max_30m"),
        F.greatest("leak_max_60m", "max_60m").alias("leak_max_60m"),
        run["leak"].alias("sustained_leak_max"),
        run["minutes"].alias("sustained_leak_minutes"),
    )


# --- histograms and percentiles --------------------------------------------------------------------------------


def histogram(samples: DataFrame, keys: Sequence[str], value: str = "value", seconds: str = "sample_seconds") -> DataFrame:
    """Count and seconds per value rounded to three decimals."""
    return samples.groupBy(*keys, F.round(value, 3).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("seconds")
    )


def merge_histograms(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up bins of several histograms; NULL and NaN bins and counts of zero or less are skipped."""
    return (
        bins.where(F.col("bin").isNotNull() & ~F.isnan("bin") & (F.col("n") > 0))
        .groupBy(*keys, "bin")
        .agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"))
    )


def histogram_percentile(p: float, bin_: str = "bin", n: str = "n") -> Column:
    """Interpolated percentile of the values a histogram stands for (an aggregate over its bins)."""
    return F.percentile(bin_, F.lit(p), F.col(n))


def minutes_at(value: Column, bin_: str = "bin", seconds: str = "seconds") -> Column:
    """Minutes spent exactly at a value (an aggregate over bins)."""
    total = F.sum(F.when(F.col(bin_) == F.round(value, 3), F.col(seconds)))
    return F.when(total > 0, total / 60)


#: Distinct values of a group that one task ranks at most, and the pieces a larger group is cut into in each round.
RANKED, PIECES = 65_536, 256


def _wanted(probabilities: dict[str, float]) -> Column:
    """The two ranks (from zero) between which each percentile of ``__total`` values lies, and how far it lies along."""
    out = []
    for name, p in probabilities.items():
        rank = F.lit(p) * (F.col("__total") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            out.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), at.alias("at"), (rank - F.floor(rank)).alias("blend")))
    return F.array(*out)


def _narrowed(counts: DataFrame, segments: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The pieces of the segments, of about equal numbers of distinct values, and the values with the piece they lie in.

    ``segments``: keys, ``__seg``, ``__before`` (values of the group that lie below) and ``__total``.  The pieces' bounds
    follow the data: they are approximate percentiles of the segment's distinct values, a sketch that combines before the
    shuffle, so a third of all values in a narrow range is cut as finely as the rest.
    """
    here = [*keys, "__seg"]
    cuts = [F.lit((n + 1) / PIECES) for n in range(PIECES - 1)]
    inside = counts.join(segments, here)
    edges = inside.groupBy(*here).agg(F.array_distinct(F.percentile_approx("__v", F.array(*cuts), 4 * PIECES)).alias("__edges"))
    # the piece of a value: how many bounds lie below it
    piece = F.size(F.filter("__edges", lambda e: e < F.col("__v")))
    cut = inside.join(edges, here).withColumn("__next", F.col("__seg") * PIECES + piece).drop("__edges")
    sums = cut.groupBy(*here, "__next", "__before", "__total").agg(F.sum("__n").alias("__piece_n"), F.count(F.lit(1)).alias("__distinct"))
    below = Window.partitionBy(*here).orderBy("__next").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("__start", F.col("__before") + F.coalesce(F.sum("__piece_n").over(below), F.lit(0)))
    return placed.select(*keys, F.col("__next").alias("__seg"), F.col("__start").alias("__before"), "__total", "__piece_n", "__distinct"), cut


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], most: int = RANKED
) -> DataFrame:
    """Exact interpolated percentiles of groups of any size.

    Equal values are counted first.  A group with more than ``most`` distinct values is narrowed down, round by round, to
    the pieces that hold the wanted ranks, until these are small; only their values are ranked.  No task ranks more than
    ``most`` values, whatever the group and however its values crowd.
    """
    keys = list(keys)
    counts = keep(
        df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__seg", F.lit(0).cast("bigint")),
        "value-counts",
    )
    wanted = _wanted(probabilities)
    holds = F.exists(wanted, lambda t: (t["at"] >= F.col("__before")) & (t["at"] < F.col("__before") + F.col("__piece_n")))
    whole = counts.groupBy(*keys, "__seg").agg(F.sum("__n").alias("__total"), F.count(F.lit(1)).alias("__distinct"))
    level = keep(whole.withColumns({"__before": F.lit(0).cast("bigint"), "__piece_n": F.col("__total")}), "segments")
    small, rows = [], counts
    while True:
        here = [*keys, "__seg"]
        fit = level.where((F.col("__distinct") <= most) & holds)
        small.append(rows.join(fit.select(*here, "__before", "__total", "__piece_n"), here))
        crowded = level.where((F.col("__distinct") > most) & holds)
        if crowded.isEmpty():
            break
        pieces, cut = _narrowed(rows, crowded.select(*here, "__before", "__total"), keys)
        level = keep(pieces, "segments")
        rows = keep(cut.drop("__seg", "__before", "__total").withColumnRenamed("__next", "__seg"), "value-counts")
    ranked = reduce(DataFrame.unionByName, small)
    in_order = Window.partitionBy(*keys, "__seg").orderBy("__v")
    ends = F.col("__before") + F.sum("__n").over(in_order)
    placed = ranked.withColumn("__end", ends).withColumn("__begin", F.col("__end") - F.col("__n"))
    hits = placed.withColumn("__t", F.explode(wanted)).where((F.col("__t.at") >= F.col("__begin")) & (F.col("__t.at") < F.col("__end")))
    out = []
    for name in probabilities:
        of = lambda side, name=name: (F.col("__t.name") == name) & (F.col("__t.side") == side)
        lo = F.max(F.when(of("lo"), F.col("__v") * (1 - F.col("__t.blend"))))
        hi = F.max(F.when(of("hi"), F.col("__v") * F.col("__t.blend")))
        out.append((lo + hi).alias(name))
    return hits.groupBy(*keys).agg(*out)


# --- counts and rates ------------------------------------------------------------------------------------------


def hourly(count: Column | str, hours: Column | str) -> Column:
    """Events per hour; NULL without a usage between zero and 24 hours."""
    c, h = _c(count), _c(hours)
    return F.when((h > 0) & (h <= 24), c / h)


def none_if_zero(count: Column) -> Column:
    return F.when(count > 0, count)


def all_or_none(*counts: Column) -> Column:
    """Sum of components, NULL as soon as one of them is missing."""
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return total


# --- settings --------------------------------------------------------------------------------------------------


def mixed_day_settings(records: DataFrame, keys: Sequence[str] = DAY) -> DataFrame:
    """Settings of a day from its records in order: one signature, or a nested ``mixed:`` text.

    Leading records with the first signature never change the text and are dropped before anything is collected; the
    records left of a mixed day are as many as the parts of the text they build.
    """
    keys = list(keys)
    usable = records.where(F.length(F.trim("signature")) > 0).select(
        *keys, "seq", F.trim("signature").alias("signature"),
        F.coalesce(F.when(F.length(F.trim("label")) > 0, F.trim("label")), F.lit("Therapy settings")).alias("label"),
    )
    firsts = usable.groupBy(*keys).agg(
        F.min_by(F.struct("signature", "label"), "seq").alias("first"),
        (F.min("signature") != F.max("signature")).alias("is_mixed"),
    )
    tagged = usable.join(firsts.where("is_mixed"), keys)
    turn = tagged.where(F.col("signature") != F.col("first.signature")).groupBy(*keys).agg(F.min("seq").alias("turn"))
    later = tagged.join(turn, keys).where(F.col("seq") >= F.col("turn"))
    lists = later.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("seq", "signature", "label"))).alias("rows")
    )
    start = F.struct(F.col("first.signature").alias("signature"), F.array(F.col("first.label")).alias("labels"))

    def step(acc: Column, row: Column) -> Column:
        pair = F.array_sort(F.array(acc["signature"], row["signature"]))
        labels = F.when(F.array_contains(acc["labels"], row["label"]), acc["labels"]).otherwise(
            F.array_append(acc["labels"], row["label"])
        )
        mixed = F.struct(
            F.concat(F.lit("mixed:"), F.concat_ws("|", pair)).alias("signature"), labels.alias("labels")
        )
        return F.when(acc["signature"] == row["signature"], acc).otherwise(mixed)

    empty = F.expr("cast(array() as array<struct<seq:bigint,signature:string,label:string>>)")
    folded = F.aggregate(F.coalesce("rows", empty), start, step)
    return firsts.join(lists, keys, "left").select(
        *keys,
        folded["signature"].alias("signature"),
        F.array_join(folded["labels"], " + ").alias("label"),
        "is_mixed",
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Values of the last row of each group in a given order."""
    pick = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("__r")).select(*keys, "__r.*")


def constant_or_null(value: Column | str) -> Column:
    """The value of a group if it never changes, else NULL."""
    v = _c(value)
    return F.when(F.min(v) == F.max(v), F.min(v))
