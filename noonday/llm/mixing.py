"""Mixing sources to target weights by a low-discrepancy schedule.

Sources in code point order (NULL last) weigh 1, 2, 3, 1, 2, 3, ... and share the size of the whole table. No source may
be taken more than ``epochs`` times; what it cannot give is shared among the others by weight. Slot j of the schedule is
the point frac(j * golden ratio); the cumulative targets map it to a source, and the source's slots are ranked. Each
source's documents, in an order of seeded hashes, form a stream that repeats; the stream is cut into blocks of equal
size, and the slot of rank r takes block r. Every stretch of the schedule thus holds the sources near their weights.
Slots beyond a source's last block are skipped, and blocks that no point has reached follow at the end, so a source gives
its target to the word.

Defined cases: a NULL or wordless text has size 0 and is never taken; NULL is a source of its own; repeated rows are
separate documents; a table without words has targets of 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noonday.llm.common import WORD, chosen, kept, packed_rows, running_sum

GOLDEN = (math.sqrt(5) - 1) / 2
#: Blocks of the schedule, about; the block's size follows from the table's.
SLOTS = 1 << 20
#: Slots that are ranked in one task, and cells of the unit interval that the points are looked up in.
CHUNK, CELLS = 1 << 12, 1 << 12
#: Slices of a source whose running sums are made in one task each.
SLICES = 1 << 10


def source_targets(sizes: DataFrame, epochs: int = 3) -> DataFrame:
    """``source``, ``number`` (from 0), ``source_size`` and ``target`` of a table with ``source`` and ``size``.

    Sources are filled in the order of the level at which they are full; the level of the first that isn't holds for
    all that follow. One row per source is sorted here, never the documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = sums.withColumn("number", (F.row_number().over(every) - 1).cast("long")).withColumn("weight", F.pmod("number", F.lit(3)) + 1)
    full = (F.col("source_size") * epochs).alias("full")
    filling = Window.orderBy(F.col("full") / F.col("weight"), "number")
    before, whole = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = weighed.select("*", full).withColumn("level", level).withColumn("open", F.col("full") / F.col("weight") >= F.col("level"))
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole)
    return levels.withColumn("held", F.coalesce(first, F.lit(0.0))).select(
        "source", "number", "source_size", F.least(F.col("full").cast("double"), F.col("held") * F.col("weight")).alias("target")
    )


def schedule(sources: DataFrame, block: int, n_slots: int) -> DataFrame:
    """``turn``, ``number`` and ``block``: which block of which source is taken at each turn.

    ``sources`` has ``number`` and ``need``, the whole words to take.
    """
    spark = sources.sparkSession
    order = Window.orderBy("number")
    cum = F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = sources.select("number", F.ceil(F.col("need") / block).alias("blocks"), ((cum - F.col("need")) / total).alias("low"), (cum / total).alias("high")).where("blocks > 0")
    parts = kept(parts, "parts")
    cells = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))))
    points = spark.range(n_slots).select(F.col("id").alias("turn"), F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS))
    drawn = points.join(cells, "cell").where("x >= low and x < high").select("turn", "number", "blocks", F.floor(F.col("turn") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept(counts.select("number", "chunk", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "chunks")
    rank = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("turn")) - 1
    ranked = drawn.withColumn("own", rank).join(starts.drop("n"), ["number", "chunk"]).withColumn("block", F.col("start") + F.col("own"))
    reached = starts.groupBy("number").agg(F.sum("n").alias("drawn"))
    rest = parts.join(reached, "number", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < blocks")
    rest = rest.select("number", F.explode(F.sequence(F.col("drawn"), F.col("blocks") - 1)).alias("block"))
    return ranked.where("block < blocks").select("turn", "number", "block").unionByName(rest.withColumn("turn", F.lit(n_slots) + F.col("block")))


def mix(docs: DataFrame, seed: int = 42, epochs: int = 3, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """The documents (``uid``, ``doc_id``, ``source``, ``size``, ``source_size``, ``target``) and the pieces of the mix.

    Pieces: ``turn``, ``uid``, ``start`` and ``words``: at that turn the mix takes so many words of that document from there.
    """
    counted = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = kept(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", counted.alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("spot")), "sizes")
    sources = source_targets(rows, epochs).withColumn("need", F.round("target").cast("long"))
    sources = kept(sources.withColumn("need", F.least("need", F.col("source_size") * epochs)), "sources")
    total = sources.agg(F.sum("need").alias("t")).first()["t"] or 0
    block = max(1, math.ceil(total / slots))
    turns = schedule(sources, block, math.ceil(total / block))
    named = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select(rows["*"], "number", "source_size", "target", "need")
    streamed = kept(running_sum(named, "number", ["spot", "doc_id", "size"], "size", "at", SLICES), "streams")
    again = streamed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    again = again.withColumn("begin", F.col("at") + F.col("epoch") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), "need")).where("begin < end")
    cut = again.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    low, high = F.greatest("begin", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    pieces = cut.select("number", "block", "uid", (low - F.col("begin")).alias("start"), (high - low).alias("words"))
    return streamed, pieces.join(turns, ["number", "block"]).select("turn", "uid", "start", "words")


def taken(docs: DataFrame, seed: int = 42) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` words."""
    rows, pieces = mix(docs, seed)
    sums = pieces.groupBy("uid").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "uid", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` with their columns, each as often as the mix takes it, in whole documents.

    Only one document of a source can be taken in part, the last; it is given out if half of it or more is taken. Rows
    equal in ``doc_id`` and text are given out together, as copies of one of them.
    """
    rows, pieces = mix(docs, seed)
    sums = pieces.groupBy("uid").agg(F.sum("words").alias("taken"))
    each = rows.join(sums, "uid").select("doc_id", "spot", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times"))
    times = kept(each.groupBy("doc_id", "spot").agg(F.sum("times").cast("int").alias("times")).where("times > 0"), "times")
    spot = F.xxhash64("doc_id", "text", F.lit(seed))
    met = chosen(packed_rows(docs, doc_id=F.col("doc_id"), spot=spot), times, "doc_id", "spot")
    return met.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
