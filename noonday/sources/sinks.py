"""Tables the pipeline keeps: the prepared intermediate and the report artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noonday.session import checkpoint_dir

BUCKETS = 64


def write_prepared(days: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write day buckets once, in folders by a hash of the card, so later jobs read only the cards they need.

    A bucket is spread over several tasks by clinical day, so one busy card does not make one busy writer.
    """
    bucketed = days.withColumn("card_bucket", F.pmod(F.xxhash64("card_id"), F.lit(buckets)).cast("int"))
    (
        bucketed.repartition("card_bucket", F.pmod(F.xxhash64("clinical_day"), F.lit(8)))
        .write.mode("overwrite").partitionBy("card_bucket").parquet(path)
    )


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("card_bucket")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate that several later steps read, and go on from the written table.

    The folder is the shared one the cluster names for checkpoints, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_reports(reports: DataFrame, path: str, form: str = "parquet") -> None:
    """One folder per report range."""
    reports.write.mode("overwrite").partitionBy("range_days").format(form).save(path)
