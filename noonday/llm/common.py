"""Pieces that several operators share: tables, kept intermediates, words, ASCII lower case, spread running sums."""

from __future__ import annotations

import string
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the space and the five ASCII line and tab characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only in local mode where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='noonday-shared-')}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate once to the shared folder and go on from the written table.

    A lost executor then costs only the tasks it ran, and steps that read the table twice don't compute it twice.
    Each call has a folder of its own.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Only A to Z become lower case; ``lower`` would change other scripts too."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def running_sum(df: DataFrame, group: str, order: list[str], amount: str, out: str, ranges: int) -> DataFrame:
    """``out``: the sum of ``amount`` over the rows of the same ``group`` that come before in ``order``.

    ``order[0]`` is a 64-bit hash. It cuts each group into ``ranges`` slices of equal width, each slice is summed on
    its own, and the few sums per group are added up first; so a group with a third of all rows is no single task.
    """
    width = 2**64 // ranges
    cut = F.floor(F.col(order[0]).cast("decimal(20,0)") / F.lit(width)).cast("int").alias("__slice")
    sliced = df.withColumn("__slice", cut)
    sums = sliced.groupBy(group, "__slice").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept(
        sums.select(
            F.col(group).alias("__group"), F.col("__slice").alias("__from"),
            F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("long").alias("__start"),
        ),
        "starts",
    )
    inside = Window.partitionBy(group, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = sliced.withColumn("__own", F.coalesce(F.sum(amount).over(inside), F.lit(0)).cast("long"))
    met = own.join(starts, own[group].eqNullSafe(starts["__group"]) & (own["__slice"] == starts["__from"]))
    return met.withColumn(out, F.col("__start") + F.col("__own")).drop("__slice", "__group", "__from", "__start", "__own", "__sum")


def packed_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` with all its columns in one, ``row``, beside ``keys``: so no column's name can clash with a key's."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("seq"),
        *[c.alias(n) for n, c in keys.items()],
    )


def chosen(rows: DataFrame, picked: DataFrame, *keys: str) -> DataFrame:
    """For each row of ``picked`` one of the ``rows`` with its keys (NULL is a key), with the further columns of ``picked``.

    ``picked`` has each combination of keys once. Adaptive execution may split a frequent key of the join.
    """
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(picked[k])
    met = rows.join(picked, same).select("row", "seq", *[rows[k] for k in keys], *[picked[c] for c in picked.columns if c not in keys])
    first = Window.partitionBy(*keys).orderBy("seq")
    return met.withColumn("nth", F.row_number().over(first)).where("nth = 1")
