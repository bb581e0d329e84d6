"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors of length one are projected to ``dims`` dimensions by Gaussian (2-stable) weights: the squared projected distance
of two vectors over their squared distance is chi-square distributed with ``dims`` degrees of freedom. The upper levels of
a kd-tree over the projections, fitted on a bounded sample, cut space into cells; every row is put into its cell, and a
cell's blocks are searched by the tree's lower levels. A query takes its projected neighbours leaf by leaf, nearest leaf
first, and verifies each with the true cosine. With the k-th best distance d so far, a row that is as near has a projected
distance of more than r only with the chance that a chi-square value exceeds r^2 / d^2; once that chance is at most
``miss``, the search ends. The query's own cell is searched first; the distance found there tells which other cells its
stopping radius still reaches, and only those are searched then.

Equal vectors are one entry of the index with their k + 1 least ids, which is all that k neighbours can need.

Defined cases: vectors that are NULL, empty, zero, or hold a NULL or non-finite component take no part; of several lengths
the most frequent counts (of equals the larger); of rows that repeat a query's id the least vector asks, and rows with the
query's id are never its neighbours; ties go to the smaller id; fewer candidates than k are all given; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonday.llm.common import kept

#: Rows that the upper tree is fitted on, at most; entries of a block, queries of a block and rows of a leaf.
SAMPLE, BLOCK, ASKED, LEAF, CELLS = 20_000, 4096, 4096, 64, 1024


def chi_square_bound(dims: int, miss: float) -> float:
    """The value that a chi-square variable of an even number of degrees exceeds with the chance ``miss``."""
    over = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 1e3
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) > miss else (low, mid)
    return high


@dataclass(frozen=True)
class Tree:
    """Cells of projected space: node i splits ``axis[i]`` at ``at[i]``; the leaves' boxes are ``low`` and ``high``."""

    axis: np.ndarray
    at: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, leaf: int, most: int = 1 << 30) -> tuple[Tree, list[np.ndarray]]:
        """A tree whose leaves hold about ``leaf`` of ``points`` (fewer leaves than ``most``), and the points of each."""
        dims = points.shape[1]
        axis, at, child, boxes, members = [], [], [], [], []

        def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, room: int) -> int:
            wide = points[rows].max(0) - points[rows].min(0) if len(rows) else np.zeros(dims)
            if len(rows) <= leaf or room < 2 or wide.max() <= 0:
                boxes.append((low, high))
                members.append(rows)
                return -len(boxes)
            f = int(wide.argmax())
            cut = float(np.median(points[rows, f]))
            if cut >= points[rows, f].max():
                cut = float(np.nextafter(cut, -np.inf))
            here = len(axis)
            axis.append(f)
            at.append(cut)
            child.append([0, 0])
            below, top, bottom = points[rows, f] <= cut, high.copy(), low.copy()
            top[f] = bottom[f] = cut
            child[here] = [grow(rows[below], low, top, room // 2), grow(rows[~below], bottom, high, room - room // 2)]
            return here

        grow(np.arange(len(points)), np.full(dims, -np.inf), np.full(dims, np.inf), most)
        low, high = (np.array([b[i] for b in boxes]) for i in (0, 1))
        return cls(np.array(axis, dtype=int), np.array(at), np.array(child, dtype=int).reshape(-1, 2), low, high), members

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=int) if len(self.axis) else np.full(len(points), -1)
        while (open_ := node >= 0).any():
            i = node[open_]
            node[open_] = self.child[i, (points[open_, self.axis[i]] > self.at[i]).astype(int)]
        return -node - 1

    def distance(self, point: np.ndarray) -> np.ndarray:
        """From a point to the box of each leaf."""
        return np.sqrt((np.maximum(np.maximum(self.low - point, point - self.high), 0) ** 2).sum(1))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; scaled first, so that neither tiny nor huge components vanish in the squares."""
    scale = np.abs(x).max(1, keepdims=True)
    y = x / scale
    long = np.sqrt((y * y).sum(1, keepdims=True))
    return y / long, (long * scale)[:, 0]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def usable(embedding: Column, length: int | None = None) -> Column:
    sound = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = embedding.isNotNull() & (F.size(embedding) > 0) & sound & F.exists(embedding, lambda v: v != 0)
    return F.coalesce(ok & (F.size(embedding) == length) if length is not None else ok, F.lit(False))


@dataclass(frozen=True)
class Plan:
    """What every task needs to know: the projection, the cells and the stopping rule."""

    weights: np.ndarray
    tree: Tree
    bound: float
    k: int

    def project(self, unit: np.ndarray) -> np.ndarray:
        return np.stack([(unit * w).sum(1) for w in self.weights.T], axis=1)


def _indexed(plan: Plan, blocks: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                spot = plan.project(_unit(_matrix(b["embedding"]))[0])
                yield b.assign(cell=plan.tree.cell(spot), block=b["entry"] % blocks, spot=list(spot))[["cell", "block", "ids", "embedding", "spot"]]

    return of


def _search(plan: Plan):
    """Neighbours of the queries of one block among its entries, with the radius the queries came with."""

    def of(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(asked):
            x, spot, ids = _matrix(entries["embedding"]), _matrix(entries["spot"]), entries["ids"].tolist()
            unit, _ = _unit(x)
            tree, members = Tree.fit(spot, LEAF)
            q, q_spot = _unit(_matrix(asked["embedding"]))[0], _matrix(asked["spot"])
            for i, (query, radius) in enumerate(zip(asked["query_id"].tolist(), asked["radius"].tolist(), strict=True)):
                best: list[tuple[float, int]] = []
                away = tree.distance(q_spot[i])
                for leaf in np.argsort(away, kind="stable"):
                    if away[leaf] > radius:
                        break
                    rows = members[leaf]
                    near = rows[((spot[rows] - q_spot[i]) ** 2).sum(1) <= radius * radius]
                    if not len(near):
                        continue
                    score = (unit[near] * q[i]).sum(1)
                    worst = best[-1][0] if len(best) == plan.k else np.inf
                    found = [(-s, v) for s, r in zip(score.tolist(), near.tolist(), strict=True) if -s <= worst for v in ids[r] if v != query]
                    if found:
                        best = sorted(best + found)[: plan.k]
                        if len(best) == plan.k:
                            radius = min(radius, math.sqrt(max(0.0, 2 + 2 * best[-1][0]) * plan.bound) + 1e-9)
                out += [(query, v, -s) for s, v in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return of


def _reached(plan: Plan):
    """The cells other than the query's own that its stopping radius reaches."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for query, embedding, spot, cell, kth in zip(b["query_id"], b["embedding"], b["spot"], b["cell"], b["kth"], strict=True):
                radius = math.sqrt(max(0.0, 2 - 2 * kth) * plan.bound) + 1e-9 if not math.isnan(kth) else math.inf
                for c in np.flatnonzero(plan.tree.distance(np.asarray(spot)) <= radius):
                    if c != cell:
                        out.append((query, embedding, spot, int(c), radius))
            yield pd.DataFrame(out, columns=["query_id", "embedding", "spot", "cell", "radius"])

    return of


def search(vectors: DataFrame, is_query: Column, k: int = 5, dims: int = 6, miss: float = 0.05, seed: int = 42) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the cosine."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    lengths = rows.where(usable(F.col("embedding"))).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = lengths["n"] if lengths else 1
    rows = rows.where(usable(F.col("embedding"), length))
    fewest = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    entries = rows.withColumn("n", fewest).where(F.col("n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = kept(entries.withColumn("entry", F.xxhash64("embedding").bitwiseAND(F.lit(2**62 - 1))), "entries")
    n = entries.count()
    wide = 1 << 20
    sample = entries.where(F.pmod("entry", F.lit(wide)) <= int(min(1.0, 0.97 * SAMPLE / max(1, n)) * wide)).limit(SAMPLE).select("entry", "embedding").toPandas()
    weights = np.random.default_rng(seed).standard_normal((length, dims))
    loose = Plan(weights, None, chi_square_bound(dims, miss), k)
    points = loose.project(_unit(_matrix(sample.sort_values("entry")["embedding"]))[0]) if len(sample) else np.zeros((1, dims))
    cells = max(1, min(CELLS, -(-n // BLOCK)))
    plan = Plan(weights, Tree.fit(points, max(1, len(points) // cells), cells)[0], loose.bound, k)
    blocks = max(1, -(-n // (BLOCK * cells)))
    index = kept(entries.mapInPandas(_indexed(plan, blocks), "cell int, block long, ids array<long>, embedding array<double>, spot array<double>"), "index")

    one = F.row_number().over(Window.partitionBy("vec_id").orderBy("embedding"))
    asking = rows.where(is_query).withColumn("n", one).where("n = 1").select("vec_id", "embedding")
    placed = asking.select("embedding", F.array("vec_id").alias("ids"), F.col("vec_id").alias("entry")).mapInPandas(
        _indexed(plan, 1), "cell int, block long, ids array<long>, embedding array<double>, spot array<double>"
    )
    asking = kept(placed.select(F.col("ids")[0].alias("query_id"), "embedding", "spot", "cell"), "asking")
    parts = max(1, -(-asking.count() // ASKED))

    def blockwise(asked: DataFrame) -> DataFrame:
        """Each block of entries meets the queries that reach its cell, ``ASKED`` or about as many at a time."""
        left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        key = ["cell", "block", "part"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(plan), "query_id long, vec_id long, score double")

    def nearest(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    at_home = kept(nearest(blockwise(asking.withColumn("radius", F.lit(float("inf"))))).drop("rank"), "home")
    kth = at_home.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    reach = asking.join(kth, "query_id", "left").select("query_id", "embedding", "spot", "cell", F.coalesce("kth", F.lit(float("nan"))).alias("kth"))
    reach = reach.mapInPandas(_reached(plan), "query_id long, embedding array<double>, spot array<double>, cell int, radius double")
    return nearest(at_home.unionByName(blockwise(reach))).select("query_id", "rank", "vec_id", "score")
