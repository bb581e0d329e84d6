"""Two-pass external shuffle of whole records into shards of equal row count.

Pass one scatters the records, with all their columns, uniformly into buckets that fit one task's memory, by a seeded
hash; each bucket is one partition. Pass two reads one bucket at a time, puts its records in a fixed order, and shuffles
them with Spark's array ``shuffle``, a Fisher-Yates shuffle whose seed is the given one plus the partition's number; a lost
task gives the same order again. The buckets one after the other are a random order of the whole table; dealing that order
out round the shards makes their row counts at most one apart (law ``rows``). Each task writes its bucket's records into
the shards' folders, in the order of their slots. Buckets are counted from the scattered records themselves, so texts
move once; the written shards are counted again, and a gap is an error.

Defined cases: a NULL text has no bytes; a NULL ``doc_id`` is placed by the rest of its row; equal texts with different
ids scatter like any other rows; exact repeats of a row are told apart by a salt; an empty table gives no rows and no
shards; further columns are carried by ``write_shards`` and left out by ``place``. A record larger than a bucket is in memory
whole.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noonday.llm.common import shared_folder

#: Bytes of a bucket of whole records: a task holds a few copies of this.
BUCKET_BYTES = 32 << 20
#: Bytes of a record besides its text.
ROW_BYTES = 64


def _shuffled(rows: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """One row per ``bucket`` with its records (column ``doc``) in shuffled order; ``doc`` must be orderable."""
    salt = F.monotonically_increasing_id()
    bucket = F.pmod(F.xxhash64("doc", F.pmod(salt, F.lit(1 << 20)), F.lit(seed)), F.lit(n_buckets)).cast("int")
    scattered = rows.select("doc", bucket.alias("bucket")).repartitionById(n_buckets, F.col("bucket"))
    whole = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    return whole.select("bucket", F.shuffle("docs", seed).alias("docs"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, seed: int = 42, bucket_bytes: int = 64 << 20) -> None:
    """Write whole documents (column ``doc``) with their ``slot``, gapless in the shard, one folder per shard and bucket.

    Each file is in the order of its slots; the shards' row counts are at most one apart.
    """
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)
    total = docs.agg(size.alias("b")).first()["b"] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    mixed = _shuffled(packed, n_buckets, seed)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = mixed.select("bucket", F.size("docs").cast("long").alias("n"))
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # one narrow row per bucket_bytes of text
    met = mixed.join(F.broadcast(starts), "bucket").select("bucket", "start", F.posexplode("docs").alias("place", "doc"))
    spot = F.col("start") + F.col("place")
    dealt = met.select(
        "doc", F.floor(spot / n_shards).cast("long").alias("slot"), F.pmod(spot, F.lit(n_shards)).cast("int").alias("shard"), "bucket"
    )
    dealt.sortWithinPartitions("shard", "bucket", "slot").write.partitionBy("shard", "bucket").parquet(path)
    if total:
        _check(docs.sparkSession.read.parquet(path), n_shards)


def _check(written: DataFrame, n_shards: int) -> None:
    """Slots are gapless and row counts at most one apart, else the input has changed between two reads."""
    found = written.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.sum("slot").alias("sum")).collect()
    n = {r["shard"]: r["n"] for r in found}
    even = max(n.values()) - min(n.get(s, 0) for s in range(n_shards)) <= 1
    if not even or any(r["last"] != r["n"] - 1 or r["sum"] != r["n"] * (r["n"] - 1) // 2 for r in found):
        raise ValueError("the documents changed while they were sharded")


def place(docs: DataFrame, n_shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shards to the shared folder and read back, in their order, one row per document.

    ``doc_id``, ``size``, ``text_crc32``, ``shard`` (from 0), ``slot`` (gapless in the shard).
    """
    path = f"{shared_folder(docs.sparkSession)}/llm-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, n_shards, seed, bucket_bytes)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).schema
    written = docs.sparkSession.read.schema(packed.add("slot", "long").add("shard", "integer").add("bucket", "integer")).parquet(path)
    return written.select(
        F.col("doc.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length("doc.text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("doc.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        "shard",
        "slot",
    ).orderBy("shard", "slot")
