"""Hard negatives of anchors, found by segment summaries before exact scores.

The index stores the mean and the deviation of each segment of a vector (the deviation is the length of what the mean leaves).
The inner product of two vectors lies between the sum over segments of size * mean * mean, plus or minus the sum of the
products of deviations. A search starts with segments of ``WIDTHS[0]`` components, drops every row that can't
be among the wanted ones by these bounds, refines the rest with the next smaller segments, and scores what is left exactly.
Coarse summaries are merged from the stored fine ones.

Two searches, each over the whole table: first the best rows with the anchor's label (its positives), then for each
positive the best rows with another label whose score lies in a window below the positive's. Rows are dealt into blocks of equal
size by a hash of their id, whatever their label, so a label with a third of all rows is spread like any other; the index
is shuffled once in each search. Anchors are the stated query set: each block meets them all, streamed in Arrow batches past the block's
rows, and gives its best few of each. No pair is a row of any table.

Defined cases: rows with a NULL id, label or vector or a NULL or non-finite component take no part; nor do vectors of another
length than the most frequent one (of equals the larger), empty ones among them, and vectors whose scaled squared length
reaches 2**53, beyond which scores would not be exact; of rows that repeat an id the one with the least label, then vector,
counts; ties go to the smaller id; an anchor without positives, or a positive without negatives in its window, gives no row; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonday.llm.common import kept

#: Components of a segment, from coarse to the stored ones; each divides the one before it.
WIDTHS = (32, 16, 4)
#: Rows of a block at most; blocks that a small table is dealt into, for parallel work, and their least rows.
ROWS, SPREAD, FEWEST = 1 << 17, 64, 512
#: Scores worked out at a time, and the share of them under which single pairs are refined instead of the whole square.
SQUARE, SPARSE = 1 << 20, 0.05


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id``, ``label`` and the scaled ``vector`` of the rows that take part, one for each id."""
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = F.transform("embedding", lambda v: F.floor(v * scale).cast("double"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", "label", whole.alias("vector"))
    rows = rows.where(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v) < float(2**53))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("vector") == (length["n"] if length else 0))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def sizes(dims: int, width: int) -> np.ndarray:
    """Components of each segment; only the last one may be shorter."""
    return np.diff(np.append(np.arange(0, dims, width), dims))


def summary(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the segments of each row."""
    n = sizes(x.shape[1], width)
    mean = np.add.reduceat(x, np.arange(0, x.shape[1], width), axis=1) / n
    left = x - np.repeat(mean, n, axis=1)
    return mean, np.sqrt(np.add.reduceat(left * left, np.arange(0, x.shape[1], width), axis=1))


def merged(mean: np.ndarray, deviation: np.ndarray, dims: int, fine: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The summary of segments of ``width`` components from that of ``fine`` ones."""
    n, starts = sizes(dims, fine), np.arange(0, mean.shape[1], width // fine)
    whole = np.add.reduceat(mean * n, starts, axis=1) / sizes(dims, width)
    apart = mean - np.repeat(whole, sizes(mean.shape[1], width // fine), axis=1)
    return whole, np.sqrt(np.add.reduceat(deviation**2 + n * apart**2, starts, axis=1))


class Rows:
    """Vectors with their summaries at every width; means are scaled, so that their product counts a segment's size."""

    def __init__(self, b: pa.RecordBatch):
        self.ids, self.labels = (np.asarray(b.column(c), dtype=np.int64) for c in ("vec_id", "label"))
        self.x = _matrix(b.column("vector"))
        dims, mean, deviation = self.x.shape[1], _matrix(b.column("mean")), _matrix(b.column("deviation"))
        merge = [merged(mean, deviation, dims, WIDTHS[-1], w) for w in WIDTHS]
        self.levels = [(m * np.sqrt(sizes(dims, w)), d) for (m, d), w in zip(merge, WIDTHS, strict=True)]


def _all(values: tuple[np.ndarray, np.ndarray], at: tuple[np.ndarray, np.ndarray] | None, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``one`` and ``other``: all, or those of the pairs ``at``."""
    return one @ other.T if at is None else np.einsum("ij,ij->i", one[at[0]], other[at[1]])


def within(low: np.ndarray, high: np.ndarray, k: int, may: np.ndarray, asked: Rows, rows: Rows, part: slice) -> Iterator[tuple[int, int, int, float]]:
    """(anchor, window, row, score) of the ``k`` best rows of each anchor's windows, where ``may`` allows the row.

    ``low`` and ``high`` hold the windows' ends, one row per anchor; NaN stands for no window.
    """
    windows, n = low.shape[1], may.shape[0]
    left: list = [may.copy() for _ in range(windows)]
    for j in range(windows):
        left[j] &= ~np.isnan(low[:, j : j + 1])
    for level in range(len(WIDTHS)):
        any_ = np.logical_or.reduce(left)
        if not any_.any():
            return
        (m, d), (rm, rd) = (asked.levels[level][0][part], asked.levels[level][1][part]), rows.levels[level]
        at = np.nonzero(any_) if any_.mean() < SPARSE else None
        middle, spread = _all(any_, at, m, rm), _all(any_, at, d, rd)
        spread += 1e-6 + 1e-9 * (np.abs(middle) + spread)  # for the rounding of means and deviations
        least, most = (np.full(any_.shape, -np.inf) for _ in range(2)) if at is not None else (middle - spread, middle + spread)
        if at is not None:
            least[at], most[at] = middle - spread, middle + spread
        for j in range(windows):
            lo, hi = low[:, j : j + 1], high[:, j : j + 1]
            left[j] &= (most >= lo) & (least <= hi)
            if any_.shape[1] > k:
                # the k-th best lower bound of rows that lie in the window for certain
                sure = np.where(left[j] & (least >= lo) & (most <= hi), least, -np.inf)
                left[j] &= most >= np.partition(sure, -k, axis=1)[:, -k][:, None]
    any_ = np.logical_or.reduce(left)
    at = np.nonzero(any_) if any_.mean() < SPARSE else None
    score = np.full(any_.shape, np.nan)
    exact = _all(any_, at, asked.x[part], rows.x)
    if at is None:
        score = exact
    else:
        score[at] = exact
    for j in range(windows):
        with np.errstate(invalid="ignore"):
            good = left[j] & (score >= low[:, j : j + 1]) & (score <= high[:, j : j + 1])
        for a in np.flatnonzero(good.any(axis=1)):
            r = np.flatnonzero(good[a])
            s = score[a, r]
            if len(r) > k:
                enough = s >= np.partition(s, -k)[-k]
                r, s = r[enough], s[enough]
            for x in np.lexsort((rows.ids[r], -s))[:k]:
                yield int(a), j, int(r[x]), float(s[x])


def _blocks(found_of, names: list[str]):
    """Rows sorted by block, in each the index first: gives ``found_of(index rows, asked rows, the batch)`` as batches."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for b in batches:
            marks = np.stack([np.asarray(b.column("block"), dtype=np.int64), np.asarray(b.column("asked").cast(pa.int64()))])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start == stop:
                    continue
                if marks[0, start] != block:
                    block, held, ready = marks[0, start], [], None
                piece = b.slice(start, stop - start)
                if not marks[1, start]:
                    held.append(piece)
                elif held or ready:
                    if ready is None:
                        ready, held = Rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), []
                    out = [tuple(map(int, r)) for r in found_of(ready, piece)]
                    if out:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return of


def _parts(n: int, rows: int) -> Iterator[slice]:
    each = max(1, SQUARE // max(1, rows))
    return (slice(i, min(n, i + each)) for i in range(0, n, each))


def _positives(k: int):
    def of(rows: Rows, piece: pa.RecordBatch) -> Iterator[tuple]:
        asked = Rows(piece)
        for part in _parts(len(asked.ids), len(rows.ids)):
            may = (asked.labels[part][:, None] == rows.labels) & (asked.ids[part][:, None] != rows.ids)
            ends = np.full((may.shape[0], 1), np.inf)
            for a, _, r, s in within(-ends, ends, k, may, asked, rows, part):
                yield asked.ids[part][a], rows.ids[r], s

    return of


def _negatives(k: int, low: int, high: int):
    def of(rows: Rows, piece: pa.RecordBatch) -> Iterator[tuple]:
        asked = Rows(piece)
        targets = piece.column("positives").to_pylist()
        widest = max(len(t) for t in targets)
        score = np.full((len(targets), widest), np.nan)
        for i, t in enumerate(targets):
            score[i, : len(t)] = [p["score"] for p in t]
        # scores are whole: the window's ends as whole numbers
        first, last = np.ceil(score * low / 100 - 1e-6), np.floor(score * high / 100 + 1e-6)
        for part in _parts(len(asked.ids), len(rows.ids)):
            may = asked.labels[part][:, None] != rows.labels
            for a, j, r, s in within(first[part], last[part], k, may, asked, rows, part):
                p = targets[part.start + a][j]
                if low * p["score"] <= 100 * s <= high * p["score"]:
                    yield asked.ids[part][a], p["vec_id"], p["score"], rows.ids[r], s

    return of


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            found = summary(_matrix(b.column("vector")), WIDTHS[-1])
            for name, x in zip(("mean", "deviation"), found, strict=True):
                b = b.append_column(name, pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel()))
            yield b


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, most: int = ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Of the rows with another label than the anchor's, the ``negatives`` best ones whose score is ``low`` to ``high`` hundredths
    of the positive's, for each of the ``positives`` best rows with the anchor's label.
    """
    rows = usable(vectors, scale).where(F.size("vector") > 0)
    index = kept(rows.mapInArrow(_summaries, "vec_id long, label long, vector array<double>, mean array<double>, deviation array<double>"), "index")
    n = index.count()
    blocks = max(1, -(-n // most), min(SPREAD, n // FEWEST))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    nothing = F.lit(None).cast("array<struct<vec_id:bigint,score:bigint>>").alias("positives")
    held = index.select("*", nothing, block.alias("block"), F.lit(False).alias("asked"))
    anchors = index.where(is_anchor)

    def met(asking: DataFrame, found_of, names: list[str]) -> DataFrame:
        """What every block gives for the anchors, which are copied to each."""
        copies = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asked", F.lit(True))
        dealt = held.unionByName(copies).repartition("block").sortWithinPartitions("block", "asked")
        return dealt.mapInArrow(_blocks(found_of, names), ", ".join(f"{c} long" for c in names))

    best = lambda by, score, of: Window.partitionBy(*by).orderBy(F.desc(score), of)
    near = met(anchors.select("*", nothing), _positives(positives), ["anchor_id", "vec_id", "score"])
    near = near.withColumn("rank", F.row_number().over(best(["anchor_id"], "score", "vec_id"))).where(F.col("rank") <= positives)
    targets = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "score"))).alias("positives"))
    asking = kept(anchors.join(targets, anchors["vec_id"] == targets["anchor_id"]).select(*index.columns, "positives"), "anchors")
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    hard = met(asking, _negatives(negatives, low, high), names)
    hard = hard.withColumn("rank", F.row_number().over(best(names[:2], "negative_score", "negative_id"))).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
