"""Streaming forms of the day roll-up, mask sessions, leak episodes and the arrival of new cards.

Each has a batch twin in :mod:`noonday.operators` and gives the same result on the same input. A stream gives a window
out once the watermark has passed it; :func:`with_end` and :func:`mark_end` close what is open when the input ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from noonday.functions.dates import seconds_between, shift_seconds
from noonday.operators.rollup import day_parts, merge_day_parts
from noonday.operators.series import INACTIVE_TAIL_SECONDS, LARGE_LEAK_LPM


def stream_day_rollup(samples: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Count, sum and maximum per card and clinical day, emitted when the day can no longer change."""
    shifted = samples.withColumn("at", F.col("ts") - F.expr("INTERVAL 12 HOURS"))
    return (
        shifted.withWatermark("at", lateness)
        .groupBy("card_id", F.window("at", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))
        .select("card_id", F.to_date("w.start").alias("clinical_day"), "n", "total", "top")
    )


def stream_mask_sessions(
    samples: DataFrame, active: Column, gap: str = "5 seconds", tail_seconds: float = INACTIVE_TAIL_SECONDS, lateness: str = "1 hour"
) -> DataFrame:
    """Mask-on sessions as session windows, by the batch rules.

    A session window joins samples less than the gap apart; a long inactive tail ends the session at its last active
    sample, and a session without one gives nothing.
    """
    seen = (
        samples.withWatermark("ts", lateness)
        .groupBy("card_id", F.session_window("ts", gap).alias("w"))
        .agg(
            F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"), F.max(F.when(active, F.col("ts"))).alias("last_active"),
            F.count(F.lit(1)).alias("n_samples"),
        )
    )
    by_tail = seconds_between("last_active", "last_ts") >= tail_seconds
    end = F.when(by_tail, F.col("last_active")).otherwise(shift_seconds("last_ts", 1))
    return seen.where(F.col("last_active").isNotNull()).select("card_id", "start_ts", end.alias("end_ts"), "n_samples")


_EPISODE = "card_id long, start_ts timestamp, end_ts timestamp, n_samples long, peak double"
_STATE = "start_us long, end_us long, n_samples long, peak double"
_COLUMNS = ["card_id", "start_ts", "end_ts", "n_samples", "peak"]


def _episodes(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Runs above the threshold; the run still open at the end of a batch is the state of its card.

    Of each piece only times, ties and values are held, as numbers; the runs are found on the sorted arrays at once.
    """

    def rows(runs: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame([(key[0], *r) for r in runs], columns=_COLUMNS)
        return found.assign(**{c: pd.to_datetime(found[c], unit="us") for c in ("start_ts", "end_ts")})

    if state.hasTimedOut:
        run = state.get
        state.remove()
        yield rows([run])
        return
    parts = [(b["ts"].to_numpy("datetime64[us]").astype(np.int64), b["seq"].to_numpy(float), b["value"].to_numpy(float)) for b in batches]
    at, seq, value = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((seq, at))
    at, value = at[order], value[order]
    above = value > LARGE_LEAK_LPM
    edges = np.flatnonzero(np.diff(np.concatenate(([0], above.astype(np.int8), [0])))).reshape(-1, 2)
    runs = [(int(at[i]), int(at[j - 1]), int(j - i), float(value[i:j].max())) for i, j in edges]
    if state.exists:
        open_ = state.get
        if runs and above[0]:
            first = runs[0]
            runs[0] = (open_[0], first[1], open_[2] + first[2], max(open_[3], first[3]))
        else:
            runs.insert(0, tuple(open_))
    if len(above) and above[-1]:
        last = runs.pop()
        state.update(last)
        state.setTimeoutTimestamp(last[1] // 1000 + 1000)
    elif state.exists:
        state.remove()
    yield rows(runs)


def stream_episodes(samples: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Leak episodes per card as a state machine; one small open run per card is kept between batches.

    Samples of a card must reach the stream in time order across batches (as a device sends them).
    """
    return (
        samples.withWatermark("ts", lateness)
        .select("card_id", "ts", "seq", "value")
        .groupBy("card_id")
        .applyInPandasWithState(_episodes, _EPISODE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def with_end(samples: DataFrame, folder: str) -> DataFrame:
    """The stream, and the end marker that :func:`mark_end` puts into ``folder`` once everything has been read."""
    spark = samples.sparkSession
    return samples.unionByName(spark.readStream.schema(samples.schema).parquet(folder))


def mark_end(spark: SparkSession, schema: StructType, folder: str, ts: str = "ts") -> None:
    """Write the end marker: a row without card, later than all samples.

    It moves the watermark past every window that is still open, so the next run gives them out.
    """
    late = F.lit("2200-01-01 00:00:00").cast("timestamp")
    columns = [(late if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*columns).write.mode("append").parquet(folder)


def upsert_days(spark: SparkSession, path: str):
    """``foreachBatch`` sink: adds the day aggregates of a batch of records as one more set of mergeable parts.

    A batch writes its own folder, so a batch that is run again replaces itself; readers merge the folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        day_parts(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return merge_day_parts(spark.read.parquet(path).drop("batch"))
