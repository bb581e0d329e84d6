"""Ordered scans over long tracks.

A *track* is one ordered sequence of rows (the samples of a card, the sessions of a card ...).  A plain window
``partitionBy(card)`` puts a whole track into one task, so a card that holds a third of the data would hold up the
job.  The functions here cut every track into chunks of time, scan each chunk on its own, reduce each chunk to one
row, scan those few rows per track, and join the result back as the state a chunk starts from:

    rows --window(keys, chunk)--> local result
      \\--groupBy(keys, chunk)--> one row per chunk --window(keys)--> state before each chunk --join--> result

All three big steps share one hash partitioning on (keys, chunk), so the rows are shuffled once.  The per-track
window sees one row per chunk (a day of 1-second samples is 86,400 rows).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"


@dataclass(frozen=True)
class Track:
    """Keys of a track, a total order inside it, and an expression that never decreases along that order."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: Column

    def rows(self) -> Window:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*self.order)

    def chunks(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(CHUNK)


def by_day(keys: Sequence[str], order: Sequence[str]) -> Track:
    """Track cut at midnight of its first order column (a timestamp)."""
    return Track(tuple(keys), tuple(order), F.date_trunc("day", F.col(order[0])))


def by_hour(keys: Sequence[str], order: Sequence[str]) -> Track:
    return Track(tuple(keys), tuple(order), F.date_trunc("hour", F.col(order[0])))


def by_block(keys: Sequence[str], order: Sequence[str], size: int) -> Track:
    """Track cut into equal spans of its first order column (a number)."""
    return Track(tuple(keys), tuple(order), F.floor(F.col(order[0]) / F.lit(size)))


def _join_state(df: DataFrame, state: DataFrame, track: Track) -> DataFrame:
    # Chunk ids and keys may be NULL-free by construction; the state has one row per (keys, chunk).
    return df.join(state, [*track.keys, CHUNK], "left")


def numbered(df: DataFrame, track: Track, name: str = "pos") -> DataFrame:
    """1-based position of every row in its track."""
    cut = df.withColumn(CHUNK, track.chunk)
    sizes = cut.groupBy(*track.keys, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    before = track.chunks().rowsBetween(Window.unboundedPreceding, -1)
    state = sizes.select(
        *track.keys, CHUNK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    local = cut.withColumn("__rn", F.row_number().over(track.rows()))
    return (
        _join_state(local, state, track)
        .withColumn(name, (F.col("__rn") + F.col("__before")).cast("bigint"))
        .drop("__rn", "__before", CHUNK)
    )


def previous(df: DataFrame, track: Track, columns: dict[str, Column | str]) -> DataFrame:
    """Values of the row before, over the whole track; NULL on the first row.  ``columns``: new name -> value."""
    values = {k: (F.col(v) if isinstance(v, str) else v) for k, v in columns.items()}
    packed = F.struct(*[v.alias(k) for k, v in values.items()])
    cut = df.withColumn(CHUNK, track.chunk).withColumn("__now", packed)
    tails = cut.groupBy(*track.keys, CHUNK).agg(
        F.max_by("__now", F.struct(*track.order)).alias("__tail")
    )
    state = tails.select(*track.keys, CHUNK, F.lag("__tail").over(track.chunks()).alias("__carry"))
    local = cut.withColumn("__lag", F.lag("__now").over(track.rows()))
    joined = _join_state(local, state, track).withColumn("__prev", F.coalesce("__lag", "__carry"))
    return joined.select(
        *df.columns, *[F.col(f"__prev.{k}").alias(k) for k in values]
    )


def running(
    df: DataFrame,
    track: Track,
    columns: dict[str, tuple[str, Column | str]],
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates from the start of the track: ``new name -> (kind, value)``.

    Kinds: ``sum``, ``max``, ``min`` and ``last`` (last value that is not NULL).  ``inclusive=False`` leaves the
    current row out, so the first row of a track gets NULL.
    """
    cut = df.withColumn(CHUNK, track.chunk)
    values = {}
    for name, (kind, value) in columns.items():
        cut = cut.withColumn(f"__v_{name}", F.col(value) if isinstance(value, str) else value)
        values[name] = kind
    frame = track.rows().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = track.chunks().rowsBetween(Window.unboundedPreceding, -1)
    reduce_chunk, carry, local = [], [], {}
    for name, kind in values.items():
        v = F.col(f"__v_{name}")
        if kind == "last":
            reduce_chunk.append(
                F.max_by(v, F.when(v.isNotNull(), F.struct(*track.order))).alias(f"__r_{name}")
            )
            carry.append(F.last(f"__r_{name}", ignorenulls=True).over(earlier).alias(f"__c_{name}"))
            local[f"__l_{name}"] = F.last(v, ignorenulls=True).over(frame)
        else:
            agg = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
            reduce_chunk.append(agg(v).alias(f"__r_{name}"))
            carry.append(agg(F.col(f"__r_{name}")).over(earlier).alias(f"__c_{name}"))
            local[f"__l_{name}"] = agg(v).over(frame)
    state = cut.groupBy(*track.keys, CHUNK).agg(*reduce_chunk).select(*track.keys, CHUNK, *carry)
    joined = _join_state(cut.withColumns(local), state, track)
    out = []
    for name, kind in values.items():
        now, before = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind == "last":
            merged = F.coalesce(now, before)
        elif kind == "sum":
            merged = F.when(now.isNull(), before).when(before.isNull(), now).otherwise(now + before)
        else:
            merged = (F.greatest if kind == "max" else F.least)(now, before)
        out.append(merged.alias(name))
    return joined.select(*df.columns, *out)


def islands(
    df: DataFrame,
    track: Track,
    now: dict[str, Column | str],
    opens: Callable[[Column, Column], Column],
    name: str = "island",
    position: str = "at",
) -> DataFrame:
    """Cut a track where ``opens(previous, current)`` holds; the first row always opens an island.

    ``now`` names the values the test looks at; they arrive as fields of the two structs.  Adds ``position`` (1-based
    place of the row in its track) and ``name`` (place of the row that opened its island).  One pass does both: a chunk
    is reduced to its size, first and last values and its last inner opening.
    """
    packed = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in now.items()])
    local = (
        df.withColumn(CHUNK, track.chunk)
        .withColumn("__now", packed)
        .withColumns({"__lag": F.lag("__now").over(track.rows()), "__rn": F.row_number().over(track.rows())})
        .withColumn("__open", F.when((F.col("__rn") > 1) & opens(F.col("__lag"), F.col("__now")), F.col("__rn")))
    )
    chunks = local.groupBy(*track.keys, CHUNK).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min_by("__now", "__rn").alias("__head"),
        F.max_by("__now", "__rn").alias("__tail"),
        F.max("__open").alias("__inner"),
    )
    by_chunk = track.chunks()
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.withColumns(
        {"__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "__prev": F.lag("__tail").over(by_chunk)}
    )
    first = F.col("__prev").isNull() | F.coalesce(opens(F.col("__prev"), F.col("__head")), F.lit(False))
    opened = placed.withColumn("__first", F.when(first, F.col("__before") + 1)).withColumn(
        "__last", F.coalesce(F.col("__inner") + F.col("__before"), F.col("__first"))
    )
    state = opened.select(
        *track.keys, CHUNK, "__before",
        F.coalesce("__first", F.last("__last", ignorenulls=True).over(earlier)).alias("__start"),
    )
    frame = track.rows().rowsBetween(Window.unboundedPreceding, 0)
    inner = local.withColumn("__mine", F.last("__open", ignorenulls=True).over(frame))
    return (
        _join_state(inner, state, track)
        .withColumns(
            {
                position: (F.col("__rn") + F.col("__before")).cast("bigint"),
                name: F.coalesce(F.col("__mine") + F.col("__before"), F.col("__start")).cast("bigint"),
            }
        )
        .select(*df.columns, position, name)
    )


def moving_averages(
    df: DataFrame, keys: Sequence[str], position: str, value: str, sizes: dict[str, int], block_rows: int = 65_536
) -> DataFrame:
    """Averages of the last ``size`` rows of a run with positions 1, 2, 3 ..., one column per name; NULL until full.

    A run is cut into blocks of ``block_rows`` positions.  The last rows of a block that a window can reach are copied to
    the front of the next one, so every block computes its windows alone and no task holds more than a block.  Inside
    a block a window is the difference of two running sums, whatever its length; all windows share one pass.
    """
    longest = max(sizes.values())
    block_rows = max(block_rows, longest)
    block = F.floor((F.col(position) - 1) / block_rows)
    overhang = F.col(position) % block_rows
    copies = F.when(
        (overhang == 0) | (overhang > block_rows - longest + 1), F.array(block, block + 1)
    ).otherwise(F.array(block))
    order = Window.partitionBy(*keys, "__block").orderBy(position)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        df.withColumn("__home", block)
        .withColumn("__block", F.explode(copies))
        .withColumns({"__sum": F.coalesce(F.sum(F.col(value).cast("double")).over(so_far), F.lit(0.0)), "__n": F.count(value).over(so_far)})
    )

    def mean(size: int) -> Column:
        total = F.col("__sum") - F.coalesce(F.lag("__sum", size).over(order), F.lit(0.0))
        n = F.col("__n") - F.coalesce(F.lag("__n", size).over(order), F.lit(0))
        return F.when((F.col(position) >= size) & (n > 0), total / n)

    averaged = summed.withColumns({name: mean(size) for name, size in sizes.items()})
    return averaged.where(F.col("__block") == F.col("__home")).drop("__home", "__block", "__sum", "__n")
