"""Sleep-timing inference: daily dominant sessions, clock anchor, profile and sleep-day classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonday.functions.circular import DAY_MINUTES, angle, clock_distance, half_up, mean_clock, wrap
from noonday.functions.dates import clinical_day, micros, minute_of_day, minutes_between
from noonday.operators.tracks import by_hour, running

# Fixed values of the inference.
MIN_SESSION_MINUTES = 90
KERNEL_MINUTES = 150
PRINCIPAL_KERNEL_MINUTES = 180
INLIER_MINUTES = 240
LONG_EPISODE_MINUTES = 240
CANDIDATE_MINUTES = 360
SHORT_BREAK_MINUTES = 30
DRIFT_DAYS = 14
DRIFT_SESSIONS = 14
DRIFT_SIDE_DAYS = 5
DRIFT_MINUTES = 240
BOUNDARY_MINUTES = 8 * 60


def timed(sessions: DataFrame) -> DataFrame:
    """Sessions with their length and start minute of the day."""
    return sessions.withColumns(
        {"minutes": minutes_between("start_ts", "end_ts"), "start_minute": minute_of_day("start_ts")}
    )


def dominant_days(sessions: DataFrame, keys: Sequence[str] = ("card_id",)) -> DataFrame:
    """Longest session per calendar start day, first on a tie; only sessions of 90 minutes if there are three.

    One aggregate per day picks both winners, so no window ever sees more than one row per day.
    """
    row = F.struct((-micros("end_ts") + micros("start_ts")).alias("neg"), "start_ts", "end_ts")
    long_enough = minutes_between("start_ts", "end_ts") >= MIN_SESSION_MINUTES
    days = sessions.groupBy(*keys, F.to_date("start_ts").alias("start_day")).agg(
        F.min(row).alias("any_best"),
        F.min(F.when(long_enough, row)).alias("long_best"),
        F.count_if(long_enough).alias("n_long"),
    )
    enough = F.sum("n_long").over(Window.partitionBy(*keys)) >= 3
    pick = days.withColumn("best", F.when(enough, F.col("long_best")).otherwise(F.col("any_best")))
    return timed(
        pick.where(F.col("best").isNotNull()).select(*keys, "start_day", "best.start_ts", "best.end_ts")
    )


def steady(value: Column) -> Column:
    """Nine decimals: what the order of a sum leaves in the last digits must not decide how a derived value rounds."""
    return F.round(value, 9)


def duration_weight(minutes: Column) -> Column:
    return F.sqrt(F.least(F.lit(720.0), minutes) / 60)


def anchor_candidates(dominant: DataFrame, keys: Sequence[str] = ("card_id",)) -> DataFrame:
    """Best start minute per card by a Gaussian kernel over all dominant sessions; needs three of them.

    A card has one dominant session per day, so its list is as long as its days; the score of every candidate is
    computed inside the row, without emitting pairs.
    """
    entry = F.struct(
        "start_ts", F.col("start_minute").alias("m"), duration_weight(F.col("minutes")).alias("w"), "minutes"
    )
    lists = dominant.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("days"))

    def score(candidate: Column) -> Column:
        return F.aggregate(
            "days",
            F.lit(0.0),
            lambda acc, s: acc
            + F.exp(F.lit(-0.5) * F.pow(clock_distance(candidate["m"], s["m"]) / KERNEL_MINUTES, 2)) * s["w"],
        )

    scored = F.transform(
        "days",
        lambda c: F.struct((-F.round(score(c), 9)).alias("neg"), c["start_ts"].alias("start_ts"), c["m"].alias("m")),
    )
    best = F.array_min(scored)
    return (
        lists.where(F.size("days") >= 3)
        .withColumn("best", best)
        .select(
            *keys, "days", F.size("days").cast("bigint").alias("observed_days"),
            F.col("best.m").alias("candidate"), (-F.col("best.neg")).alias("score"),
        )
    )


def inliers(candidates: DataFrame, keys: Sequence[str] = ("card_id",)) -> DataFrame:
    """Dominant sessions within four hours of the candidate."""
    return (
        candidates.select(*keys, "observed_days", "candidate", F.explode("days").alias("d"))
        .select(*keys, "observed_days", "candidate", "d.start_ts", "d.m", "d.w", "d.minutes")
        .where(clock_distance(F.col("candidate"), F.col("m")) <= INLIER_MINUTES)
    )


def anchors(dominant: DataFrame, keys: Sequence[str] = ("card_id",)) -> DataFrame:
    """Anchor minute, concentration and typical duration per card; needs two inliers."""
    near = inliers(anchor_candidates(dominant, keys), keys)
    days = F.array_sort(F.collect_list(F.struct("minutes", "m", "w")))
    grouped = near.groupBy(*keys).agg(
        F.first("observed_days").alias("observed_days"),
        F.first("candidate").alias("candidate"),
        F.count(F.lit(1)).alias("supporting_days"),
        F.sum(F.cos(angle(F.col("m"))) * F.col("w")).alias("x"),
        F.sum(F.sin(angle(F.col("m"))) * F.col("w")).alias("y"),
        F.sum("w").alias("total_weight"),
        days.alias("days"),
    )
    anchored = grouped.where(F.col("supporting_days") >= 2).withColumn(
        "anchor", steady(mean_clock(F.col("x"), F.col("y"), F.col("candidate")))
    )
    spread = F.aggregate(
        "days", F.lit(0.0), lambda acc, d: acc + clock_distance(F.col("anchor"), d["m"])
    ) / F.col("supporting_days")
    return anchored.select(
        *keys, "observed_days", "supporting_days", "candidate", "anchor",
        steady(F.greatest(F.lit(0.0), 1 - spread / INLIER_MINUTES)).alias("concentration"),
        weighted_median("days", F.col("total_weight")).alias("median_minutes"),
    )


def weighted_median(days: str, total: Column) -> Column:
    """First value, in ascending order, at which the running weight reaches half of the total."""
    half = F.round(total / 2, 9)
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("v"))

    def step(acc: Column, d: Column) -> Column:
        w = acc["w"] + d["w"]
        hit = acc["v"].isNull() & (F.round(w, 9) >= half)
        return F.struct(w.alias("w"), F.when(hit, d["minutes"]).otherwise(acc["v"]).alias("v"))

    return F.aggregate(days, start, step)["v"]


def schedule_drift(sessions: DataFrame, keys: Sequence[str] = ("card_id",)) -> DataFrame:
    """Cards whose anchor of the last 14 days lies four hours or more from the anchor before."""
    keys = list(keys)
    card = sessions.groupBy(*keys).agg(
        F.max("start_ts").alias("newest"), F.count(F.lit(1)).alias("n_sessions")
    )
    cut = F.col("newest") - F.expr(f"INTERVAL {DRIFT_DAYS} DAYS")
    sides = (
        sessions.join(card.where(F.col("n_sessions") >= DRIFT_SESSIONS), keys)
        .withColumn("side", F.when(F.col("start_ts") >= cut, "recent").otherwise("prior"))
        .select(*keys, "side", "start_ts", "end_ts")
    )
    # The number of dominant days is the number of candidates an anchor was looked for among.
    by_side = anchors(dominant_days(sides, [*keys, "side"]), [*keys, "side"]).where(
        F.col("observed_days") >= DRIFT_SIDE_DAYS
    )
    pivoted = by_side.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "recent", F.col("anchor"))).alias("recent_anchor"),
        F.max(F.when(F.col("side") == "prior", F.col("anchor"))).alias("prior_anchor"),
    )
    return card.join(pivoted, keys, "left").select(
        *keys,
        "recent_anchor",
        "prior_anchor",
        F.coalesce(
            clock_distance(F.col("recent_anchor"), F.col("prior_anchor")) >= DRIFT_MINUTES, F.lit(False)
        ).alias("drift"),
    )


def sleep_profiles(sessions: DataFrame, keys: Sequence[str] = ("card_id",)) -> DataFrame:
    """One timing profile per card, or per card and settings period, from its de-duplicated sessions."""
    keys = list(keys)
    found = anchors(dominant_days(sessions, keys), keys)
    drift = schedule_drift(sessions, keys).select(*keys, "drift")
    typical = F.least(F.lit(720.0), F.greatest(F.lit(60.0), F.col("median_minutes")))
    raw = (
        0.5 * F.col("supporting_days") / F.greatest(F.lit(1), F.col("observed_days"))
        + 0.3 * F.col("concentration")
        + 0.2 * F.least(F.lit(1.0), F.col("observed_days") / DRIFT_DAYS)
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw - F.when(F.col("drift"), 0.2).otherwise(0.0)))
    rounded = found.join(drift, keys).withColumns(
        {
            "anchor_minutes": half_up(F.col("anchor")).cast("double"),
            "typical_minutes": half_up(typical).cast("double"),
            "confidence_score": score,
        }
    )
    return rounded.select(
        *keys, "anchor_minutes", "typical_minutes",
        wrap(F.col("anchor_minutes") + F.col("typical_minutes")).alias("window_end_minutes"),
        wrap(F.col("anchor_minutes") - BOUNDARY_MINUTES).alias("boundary_minutes"),
        "confidence_score",
        F.when(F.round("confidence_score", 9) >= 0.75, "high")
        .when(F.round("confidence_score", 9) >= 0.5, "moderate").otherwise("low").alias("confidence"),
        "supporting_days", "observed_days", "drift",
    )


def with_sleep_day(sessions: DataFrame, profiles: DataFrame, keys: Sequence[str] = ("card_id",)) -> DataFrame:
    """Calendar day of the start, one day back when it starts before the profile's boundary minute."""
    own = sessions.join(profiles.select(*keys, "anchor_minutes", "boundary_minutes"), list(keys))
    day = F.to_date("start_ts")
    early = minute_of_day("start_ts") < F.col("boundary_minutes")
    return timed(own).withColumn("sleep_day", F.when(early, F.date_sub(day, 1)).otherwise(day))


def merge_episodes(sessions: DataFrame, keys: Sequence[str], gap_minutes: float = SHORT_BREAK_MINUTES) -> DataFrame:
    """Join sessions of a group that start at most ``gap_minutes`` after everything before them has ended.

    The duration of an episode adds only the part of a session that does not overlap what came before.
    """
    track = by_hour(keys, ["start_ts", "end_ts"])
    lagged = running(sessions, track, {"__until": ("max", "end_ts")}, inclusive=False)
    gap = minutes_between("__until", "start_ts")
    opens = F.col("__until").isNull() | (gap > gap_minutes)
    overlap = F.greatest(F.lit(0.0), -gap)
    added = F.when(opens, F.col("minutes")).otherwise(F.greatest(F.lit(0.0), F.col("minutes") - overlap))
    marked = running(
        lagged.withColumn("__added", added),
        track,
        {"episode_start": ("last", F.when(opens, F.col("start_ts")))},
    )
    return marked.groupBy(*keys, "episode_start").agg(
        F.max("end_ts").alias("episode_end"),
        F.sum("__added").alias("episode_minutes"),
        F.count(F.lit(1)).alias("n_sessions"),
    )


def touched_days(sessions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Sleep days inside [start, end), or with a session whose calendar or clinical day is inside."""

    def inside(day: Column) -> Column:
        return (day >= start) & (day < end)

    touches = inside(F.col("sleep_day")) | inside(F.to_date("start_ts")) | inside(clinical_day("start_ts"))
    return sessions.groupBy("card_id", "sleep_day").agg(F.bool_or(touches).alias("touches"))


def classify_days(sessions_with_day: DataFrame, keys: Sequence[str] = ("card_id",)) -> DataFrame:
    """Total, principal and nap minutes per sleep day.

    The principal episode starts within six hours of the anchor or lasts four hours; among those the best is the
    longest after a bonus of up to one half for being close to the anchor.
    """
    day = [*keys, "sleep_day"]
    source = sessions_with_day.select(*day, "anchor_minutes", "start_ts", "end_ts", "minutes")
    episodes = merge_episodes(source, [*day, "anchor_minutes"])
    distance = clock_distance(F.col("anchor_minutes"), minute_of_day("episode_start"))
    near = F.exp(F.lit(-0.5) * F.pow(distance / PRINCIPAL_KERNEL_MINUTES, 2))
    score = F.col("episode_minutes") * (1 + 0.5 * near)
    fits = (distance <= CANDIDATE_MINUTES) | (F.col("episode_minutes") >= LONG_EPISODE_MINUTES)
    best = F.min(
        F.when(fits, F.struct((-F.round(score, 9)).alias("neg"), "episode_start",
                              F.col("episode_minutes").alias("minutes")))
    )
    grouped = episodes.groupBy(*day).agg(
        F.sum("episode_minutes").alias("total_minutes"), best.alias("best"), F.count(F.lit(1)).alias("n_episodes")
    )
    principal = F.coalesce("best.minutes", F.lit(0.0))
    return grouped.select(
        *day, "n_episodes", "total_minutes",
        principal.alias("principal_minutes"),
        F.greatest(F.lit(0.0), F.col("total_minutes") - principal).alias("nap_minutes"),
        (principal >= LONG_EPISODE_MINUTES).alias("four_hours"),
    )


def classify_totals(days: DataFrame, keys: Sequence[str] = ("card_id",)) -> DataFrame:
    return days.groupBy(*keys).agg(
        F.sum("total_minutes").alias("total_minutes"),
        F.sum("principal_minutes").alias("principal_minutes"),
        F.sum("nap_minutes").alias("nap_minutes"),
        F.count_if("four_hours").alias("timed_compliant_days"),
        F.count_if(F.col("total_minutes") > 0).alias("timed_days"),
        F.count(F.lit(1)).alias("n_sleep_days"),
    )
