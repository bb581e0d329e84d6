"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark columns.

Statistics of whole texts are column expressions. On a bounded sample of labelled rows small trees are boosted; every
path from a root to a node is a rule, a conjunction of bounds on statistics. A logistic regression with a lasso penalty,
chosen on a part of the sample set aside, keeps few of the rules. The kept rules and weights become one column expression,
so the table is scored in a single pass without Python and without a shuffle.

Labels, language, source and ids are no statistics and never enter a score.

Defined cases: a NULL text is scored as an empty one, whose shares are all 0; rows repeated in the labels weigh as often as
they come; labels other than 0 and 1 and NULL ids don't teach; without labelled rows of both kinds all scores are the
share of label 1, or 0.5 with none at all; an empty table gives no rows; further columns are ignored or passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonday.functions.plan import computed_once
from noonday.llm.common import WORD

#: Labelled rows that the trees and weights are fitted on, at most.
FIT_ROWS = 20_000
TREES, DEPTH, CUTS, LEAF, SHRINK = 40, 3, 32, 20, 0.3
#: Rules that weigh no more than this, in log-odds, are left out.
LIGHTEST = 0.01


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of one text. ``text`` should be a plain column."""
    long = F.length(text)
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    words, lines = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, "\n")
    share = lambda part, of: F.when(of > 0, part / of).otherwise(0.0)
    return {
        "chars": F.log1p(long.cast("double")),
        "words": F.log1p(F.size(words).cast("double")),
        "word_chars": share(long.cast("double"), F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)).cast("double"), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)).cast("double"), F.size(lines)),
        "line_chars": F.log1p(share(long.cast("double"), F.size(lines))),
        "letters": share(count(r"\p{L}"), long),
        "capitals": share(count(r"\p{Lu}"), long),
        "digits": share(count("[0-9]"), long),
        "marks": share(count(r"[^\p{L}\p{N}\s]"), long),
        "stops": share(count(r"[.?]"), F.size(words)),
        "commas": share(count("[,;:]"), F.size(words)),
        "shouts": share(count("!"), F.size(words)),
        "bars": share(count(r"[|\\/<>{}=_~^]"), F.size(words)),
        "symbols": share(count(r"[#$%&*@+]"), F.size(words)),
        "mark_runs": share(count(r"[^\p{L}\p{N}\s]{2,}"), F.size(words)),
        "capital_words": share(count(r"\p{Lu}{2,}"), F.size(words)),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds (statistic, is it above, value) with its weight."""

    bounds: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self) -> Column:
        held = F.lit(True)
        for name, above, value in self.bounds:
            held = held & ((F.col(name) > value) if above else (F.col(name) <= value))
        return F.when(held, F.lit(self.weight)).otherwise(0.0)


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    bias: float

    def score(self) -> Column:
        """The probability of label 1 as a column over the statistics' names."""
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column()
        return 1.0 / (1.0 + F.exp(-total))


def _grow(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, depth: int, paths: list, out: np.ndarray) -> None:
    """One regression tree on binned statistics, by gradient gain; notes the path to every node below the root."""
    if path:
        paths.append(path)
    best = (1e-6, None)
    if depth and len(rows) >= 2 * LEAF:
        g, h = grad[rows].sum(), hess[rows].sum()
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, grad[rows], CUTS))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], CUTS))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=CUTS))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (f, at))
    if best[1] is None:
        out[rows] = -grad[rows].sum() / (hess[rows].sum() + 1)
        return
    f, at = best[1]
    above = binned[rows, f] > at
    _grow(binned, grad, hess, rows[~above], (*path, (f, False, at)), depth - 1, paths, out)
    _grow(binned, grad, hess, rows[above], (*path, (f, True, at)), depth - 1, paths, out)


def _tree_paths(binned: np.ndarray, y: np.ndarray, seed: int) -> list[tuple]:
    draw, margin, paths = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(draw.random(len(y)) < 0.7)
        step = np.zeros(len(y))
        features = np.sort(draw.permutation(binned.shape[1])[: max(2, binned.shape[1] * 2 // 3)])
        found: list[tuple] = []
        _grow(binned[:, features], p - y, p * (1 - p), rows, (), DEPTH, found, step)
        margin = margin + SHRINK * step
        paths += [tuple((int(features[f]), above, at) for f, above, at in path) for path in found]
    return list(dict.fromkeys(tuple(sorted(p)) for p in paths))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the logistic loss with an L1 penalty; the bias is free."""
    n = len(y)
    rate = 4.0 / (np.linalg.norm(x, 2) ** 2 / n + 1)
    w, b = np.zeros(x.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(x @ v + c))) - y
        new = v - rate * (x.T @ e) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b, new_t = c - rate * e.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 42) -> Model:
    """Fit on a matrix of statistics and 0/1 labels."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model((), float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    paths = [p for p in _tree_paths(binned, y, seed) if all(at < len(cuts[f]) for f, _, at in p)]
    held = np.stack([np.logical_and.reduce([(binned[:, f] > at) == above for f, above, at in p]) for p in paths], axis=1).astype(float) if paths else np.zeros((len(y), 0))
    aside = np.random.default_rng(seed + 1).random(len(y)) < 0.25
    if aside.all() or not aside.any() or y[~aside].min() == y[~aside].max():
        aside = np.zeros(len(y), dtype=bool)
    best = (np.inf, 0.003)
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003) if aside.any() else ():
        w, b = _lasso(held[~aside], y[~aside], penalty)
        p = np.clip(1 / (1 + np.exp(-(held[aside] @ w + b))), 1e-9, 1 - 1e-9)
        best = min(best, (float(-np.mean(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p))), penalty))
    w, b = _lasso(held, y, best[1])
    kept = [Rule(tuple((names[f], bool(above), float(cuts[f][at])) for f, above, at in p), float(v)) for p, v in zip(paths, w, strict=True) if abs(v) > LIGHTEST]
    return Model(tuple(kept), b)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def with_statistics(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``columns`` and the statistics, each computed once for each row."""
    text = computed_once(docs.select(*columns, F.coalesce("text", F.lit("")).alias("__text")))
    found = statistics(F.col("__text"))
    return computed_once(text.select(*columns, *[c.alias(f"__{n}") for n, c in found.items()])), [f"__{n}" for n in found]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = 42) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out, drawn by a hash of their ids."""
    taught = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    taught = taught.select(F.col("doc_id"), F.col("quality").cast("double").alias("__y"))
    many, wide = max(1, taught.count()), 1 << 20
    drawn = taught.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(wide)) < int(min(1.0, 0.97 * rows / many) * wide)).limit(rows)
    # At most ``rows`` rows of two numbers: that is the bound of the broadcast.
    met = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    found, names = with_statistics(met, "doc_id", "__y")
    frame = found.toPandas().sort_values(["doc_id", "__y", *names])
    return fit_rules(frame[names].to_numpy(dtype=float), frame["__y"].to_numpy(dtype=float), names, seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` and ``predicted``."""
    found, _ = with_statistics(docs, "doc_id")
    scored = found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with their columns whose score is 0.5 or more."""
    rows = computed_once(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("__text")))
    found = statistics(F.col("__text"))
    told = computed_once(rows.select("row", *[c.alias(f"__{n}") for n, c in found.items()]))
    return told.where(model.score() >= 0.5).select("row.*")
