"""Queries: streaming twins, run to the end of the table with ``availableNow``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from noonday.plans import adapters as a
from noonday.plans.adapters import SAMPLES, with_views
from noonday.plans.q_series import MASK_ROWS, MASKS, RUNS
from noonday.plans.registry import query
from noonday.plans.sql_parts import RECORD_DAYS
from noonday.session import checkpoint_dir
from noonday.streaming import twins


def event_stream(spark, sf):
    """The events table as a file stream, in the shape of samples."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.select(
        F.col("user_id").alias("card_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "value",
        F.lit(120.0).alias("sample_seconds"), F.col("event_type").alias("kind"), "props",
    )


def run_to_end(spark, samples, build, name):
    """Run a stream over what is there, mark the end, run it on, and give back its result table."""
    base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    samples.sparkSession.createDataFrame([], samples.schema).write.parquet(f"{base}/end")
    out = build(twins.with_end(samples, f"{base}/end"))
    writer = (
        out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
    )
    writer.start().awaitTermination()
    twins.mark_end(spark, samples.schema, f"{base}/end")
    writer.start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(
    "stream_day_rollup",
    with_views(SAMPLES, body="""
SELECT card_id, CAST(ts - INTERVAL 12 HOUR AS DATE) AS clinical_day, count(*) AS n, round(sum(value), 6) AS total, max(value) AS top
FROM samples GROUP BY ALL"""),
    days="clinical_day",
)
def stream_day_rollup(spark, sf):
    return run_to_end(spark, event_stream(spark, sf), twins.stream_day_rollup, "days")


@query("stream_mask_sessions", with_views(SAMPLES, MASKS, body=MASK_ROWS), times="start_ts end_ts")
def stream_mask_sessions(spark, sf):
    def build(samples):
        return twins.stream_mask_sessions(samples, F.col("value") > 10, "8 hours", 3 * 3600.0, "1 day")

    return run_to_end(spark, event_stream(spark, sf), build, "masks")


@query(
    "stream_episodes",
    with_views(SAMPLES, RUNS, body="SELECT card_id, start_ts, end_ts, n_samples, peak FROM episodes"),
    times="start_ts end_ts",
)
def stream_episodes(spark, sf):
    return run_to_end(spark, event_stream(spark, sf), twins.stream_episodes, "episodes")


@query(
    "stream_new_cards",
    with_views(*RECORD_DAYS, body="SELECT card_id, clinical_day, n_records, round(usage_hours_sum, 6) AS usage_hours_sum FROM day_sums"),
    days="clinical_day", whole="n_records",
)
def stream_new_cards(spark, sf):
    """Records arriving as files are rolled up per micro-batch and merged on reading."""
    base = f"{checkpoint_dir(spark)}/cards-{uuid.uuid4().hex}"
    records = a.records(spark, sf)
    # more records are written by more tasks, and a micro-batch takes more files: its tasks and their sizes stay the same
    tasks = max(4, a.tasks_for(a.read(spark, sf, "events")))
    records.repartition(tasks, "seq").write.partitionBy("kind").parquet(f"{base}/in")
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 2 * tasks).parquet(f"{base}/in")
    sink = twins.upsert_days(spark, f"{base}/days")
    query_ = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    query_.start().awaitTermination()
    return twins.read_days(spark, f"{base}/days").select("card_id", "clinical_day", "n_records", "usage_hours_sum")
