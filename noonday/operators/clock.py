"""Clock offset voting and channel probing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonday.functions.dates import minutes_between

# Fixed values of the clock vote.
STEP_MINUTES = 15
TOLERANCE_MINUTES = 2
MAX_OFFSET_MINUTES = 14 * 60
DEFAULT_OFFSET_MINUTES = 480
MIN_VOTES = 2
MIN_SHARE = 0.6


def vote_clock_offset(ends: DataFrame) -> DataFrame:
    """Offset per card between file times and session ends, by majority of rounded differences.

    ``ends``: card_id, end_ts, modified_at.  A difference votes if it lies within two minutes of a quarter hour and
    within 14 hours; ties go to the smaller offset.  Without a clear majority the default offset is used.
    """
    raw = minutes_between("end_ts", "modified_at")
    near = F.floor(raw / STEP_MINUTES + 0.5) * STEP_MINUTES
    valid = (F.abs(raw - near) <= TOLERANCE_MINUTES) & (F.abs(near) <= MAX_OFFSET_MINUTES)
    # Votes are counted per offset (at most 113 distinct ones) before anything is compared per card.
    counts = ends.groupBy("card_id", F.when(valid, near).alias("off")).agg(F.count(F.lit(1)).alias("n"))
    is_vote = F.col("off").isNotNull()
    strongest = F.min(F.when(is_vote, F.struct((-F.col("n")).alias("neg"), F.abs("off").alias("abs"), "off")))
    cards = counts.groupBy("card_id").agg(
        F.sum(F.when(is_vote, F.col("n")).otherwise(0)).alias("total"), strongest.alias("best")
    )
    support = -F.col("best.neg")
    clear = F.coalesce(support >= F.greatest(F.lit(MIN_VOTES), F.ceil(F.col("total") * MIN_SHARE)), F.lit(False))
    return cards.select(
        "card_id",
        F.when(clear, F.col("best.off")).otherwise(F.lit(DEFAULT_OFFSET_MINUTES)).cast("bigint").alias("offset_minutes"),
        F.when(clear, support).otherwise(F.lit(0)).cast("bigint").alias("verified"),
    )


def probe_channels(samples: DataFrame, keys: Sequence[str], primary: str, alternate: str) -> DataFrame:
    """Use the alternate channel of a recording whose primary one has values in less than one sample of a hundred.

    All samples of the recording decide, by one aggregate.
    """
    used = F.count_if(F.col(primary) != 0)
    probe = samples.groupBy(*keys).agg(
        (used < F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 100))).alias("use_alternate")
    )
    return samples.join(probe, list(keys)).withColumn(
        "chosen", F.when(F.col("use_alternate"), F.col(alternate)).otherwise(F.col(primary))
    )
