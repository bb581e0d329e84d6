"""Records out of decoded signals: daily pivot, per-session and per-day summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonday.functions.dates import clinical_day, shift_minutes, shift_seconds
from noonday.operators.cleaning import PRESSURE, ranged
from noonday.operators.rollup import histogram, histogram_percentile
from noonday.operators.series import best_episodes, reset_islands, rolling_maxima, threshold_runs


def pivot_signals(
    signals: DataFrame, keys: Sequence[str], name: str, value: str, aliases: Sequence[tuple[str, int, str]], *more: Column
) -> DataFrame:
    """One column per metric: the first alias present wins.  ``aliases``: (metric, priority, signal name).

    ``more`` are aggregates over all signals of a group; then groups without a known signal stay, with ``n_known`` 0.
    """
    by_metric: dict[str, list[tuple[int, str]]] = {}
    for metric, priority, signal in aliases:
        by_metric.setdefault(metric, []).append((priority, signal))
    wanted = [signal for _, _, signal in aliases]
    aggs = []
    for metric, options in by_metric.items():
        rank: Column | None = None
        for priority, signal in sorted(options):
            hit = F.lower(F.col(name)) == signal.lower()
            rank = F.when(hit, priority) if rank is None else rank.when(hit, priority)
        aggs.append(F.min_by(value, F.when(F.col(value).isNotNull(), rank)).alias(metric))
    known = F.lower(F.col(name)).isin(*[w.lower() for w in wanted])
    if more:
        return signals.groupBy(*keys).agg(*aggs, F.count_if(known).alias("n_known"), *more)
    return signals.where(known).groupBy(*keys).agg(*aggs)


def daily_records(
    signals: DataFrame, aliases: Sequence[tuple[str, int, str]], units: dict[str, Callable[[Column, Column], Column]] | None = None,
    settings: Sequence[str] = (), start: str = "start_ts",
) -> DataFrame:
    """One record per data record of a daily summary file: date = start day + index.

    ``signals``: card_id, ``start``, seq, channel, unit, value.  A metric is the first of its aliases that is present, after its
    conversion from the channel's unit.  ``history_start`` is the clinical day of the card's earliest file; ``settings``
    names metrics that are settings, of which the card's latest record gives ``latest_<name>``.
    """
    known = {signal.lower(): metric for metric, _, signal in aliases}
    value = F.col("value")
    for channel, metric in known.items():
        if units and metric in units:
            value = F.when(F.lower("channel") == channel, units[metric](F.col("value"), F.col("unit"))).otherwise(value)
    dated = signals.where("card_id IS NOT NULL").withColumns({"date": F.date_add(F.to_date(start), F.col("seq").cast("int")), "value": value})
    # channels that are no metric count for the history only
    firsts = F.min(clinical_day(start)).alias("history_start")
    records = pivot_signals(dated, ["card_id", "date"], "channel", "value", aliases, firsts)
    # over the records of a card, at most one per day: no second pass over the signals, and no join back
    card = Window.partitionBy("card_id")
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).over(card).alias(f"latest_{c}") for c in settings]
    whole = records.select(
        "card_id", "date", *dict.fromkeys(known.values()), F.min("history_start").over(card).alias("history_start"), *newest, "n_known"
    )
    return whole.where("n_known > 0").drop("n_known")


def channel_stats(samples: DataFrame, keys: Sequence[str], channels: dict[str, tuple[Column, tuple, float]]) -> DataFrame:
    """Average, least, greatest, a percentile and the number of the samples in range of further channels of a file.

    ``channels``: name -> (value, its range, percentile).  Samples of all channels share one pass; equal values, rounded to
    three decimals, are counted before anything is ranked.
    """
    each = [F.struct(F.lit(n).alias("channel"), ranged(v, bounds).alias("v")) for n, (v, bounds, _) in channels.items()]
    rows = samples.select(*keys, F.inline(F.array(*each))).where("v IS NOT NULL")
    bins = rows.groupBy(*keys, "channel", F.round("v", 3).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    aggs = []
    for name, (_, _, p) in channels.items():
        of = lambda c, name=name: F.when(F.col("channel") == name, F.col(c))
        aggs += [
            (F.sum(of("sum")) / F.sum(of("n"))).alias(f"{name}_avg"), F.min(of("low")).alias(f"{name}_min"), F.max(of("high")).alias(f"{name}_max"),
            F.percentile(of("bin"), F.lit(p), F.col("n")).alias(f"{name}_p{round(p * 100)}"), F.coalesce(F.sum(of("n")), F.lit(0)).alias(f"{name}_samples"),
        ]
    return bins.groupBy(*keys).agg(*aggs)


def summarize_sessions(
    samples: DataFrame, keys: Sequence[str], order: Sequence[str], threshold: float = 30.0,
    channels: dict[str, tuple[Column, tuple, float]] | None = None,
) -> DataFrame:
    """One record per signal file: span, mean, histogram median and leak episodes, and the statistics of further channels."""
    span = samples.groupBy(*keys).agg(
        F.max(F.struct(order[0], "sample_seconds")).alias("__last"),
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("value").alias("leak"),
    )
    end = shift_seconds(F.col("__last")[order[0]], F.col("__last.sample_seconds"))
    bins = histogram(samples, keys).groupBy(*keys).agg(histogram_percentile(0.5).alias("median"))
    episodes = best_episodes(threshold_runs(samples, keys, order, threshold=threshold), keys)
    out = (
        span.withColumn("session_end", end)
        .join(bins, list(keys))
        .join(episodes, list(keys), "left")
        .drop("__last")
    )
    if not channels:
        return out
    # a file without any sample in range of a channel has none of them, not an unknown number
    return out.join(channel_stats(samples, keys, channels), list(keys), "left").fillna(0, [f"{n}_samples" for n in channels])


def summarize_days(
    samples: DataFrame,
    day: Sequence[str],
    order: Sequence[str],
    windows: dict[str, int],
    max_step_seconds: float,
    threshold: float = 30.0,
) -> DataFrame:
    """One record per card and clinical day: mean, maximum, 95th percentile, rolling maxima, leak episodes."""
    keys = ["card_id", *day]
    counted = samples.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k")
    base = counted.groupBy(*keys).agg(
        total.alias("n"),
        (F.sum(F.col("value") * F.col("k")) / total).alias("mean_leak"),
        F.max("value").alias("max_leak"),
        F.percentile("value", F.lit(0.95), F.col("k")).alias("p95"),
    )
    islands = reset_islands(samples, ["card_id"], order, F.col("value").isNotNull(), max_step_seconds)
    rolled = rolling_maxima(islands, ["card_id"], keys, "value", windows)
    runs = threshold_runs(samples, keys, order, threshold=threshold, max_step_seconds=max_step_seconds)
    episodes = best_episodes(runs, keys).select(
        *keys, "longest_minutes", "longest_leak",
        F.col("max_leak").alias("top_leak"), F.col("max_leak_minutes").alias("top_minutes"),
    )
    return base.join(rolled, keys, "left").join(episodes, keys, "left")


def summarize_intervals(samples: DataFrame, order: Sequence[str], windows: dict[str, int], threshold: float = 30.0) -> DataFrame:
    """One record per interval session: usage from the sample count, mean and maximum leak, rolling maxima, rates, leak
    episodes, and mean and 95th percentile of the pressure where the samples have one."""
    keys = ["card_id", "session_start"]
    hours = F.sum("sample_seconds") / 3600
    base = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        hours.alias("usage_hours"),
        F.avg("value").alias("mean_leak"),
        F.max("value").alias("max_leak"),
        (F.count_if(F.col("event_type") == "error") / hours).alias("error_rate"),
    ).withColumn("session_end", shift_minutes("session_start", F.round(F.col("usage_hours") * 60)))
    islands = reset_islands(samples, keys, order, F.col("value").isNotNull(), None)
    rolled = rolling_maxima(islands, keys, keys, "value", windows)
    episodes = best_episodes(threshold_runs(samples, keys, order, threshold=threshold), keys).select(
        *keys, "longest_minutes", "longest_leak", F.col("max_leak_minutes").alias("top_minutes")
    )
    out = base.join(rolled, keys, "left").join(episodes, keys, "left")
    if "pressure" not in samples.columns:
        return out
    stats = channel_stats(samples, keys, {"pressure": (F.col("pressure"), PRESSURE, 0.95)})
    return out.join(stats.select(*keys, "pressure_avg", "pressure_p95"), keys, "left")
