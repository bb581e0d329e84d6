"""Substring dedup by recompression.

Every text is a sequence of words. A first round names runs of one word, the rounds after it name pairs: names fall into
a left and a right class by a bit of the name, and a left name followed by a right one becomes a new name. A name is a
64-bit hash of what it stands for, so all tasks give the same name to the same thing with no naming table between them.
Whether two neighbours merge depends on them alone; so equal stretches of text have equal symbols inside, and differ
only near their ends. For each symbol the rounds carry the stretch of words that settles it; whoever contains an equal
stretch has the symbol at the same place.

A window of ``window`` words can only repeat if every symbol settled inside it occurs twice. Spark counts the symbols
(with the words of their settling stretch) over the whole table, and those met once come back to the list of their
document's symbols and strike out all windows around them; only numbers move for that, no texts. Each window must hold a symbol: where the highest round has none short enough, the
next lower round's symbols are counted too. What is left are the windows whose symbols are all shared. They are
verified: 128 bits of the window's words are counted over the table, and windows met twice or more cover the words that
are removed. The texts are shuffled once, to meet the windows left in them; the second join finds them where they lie.
Counting keeps one place per key, so a frequent passage is combined before it moves.

Defined cases: a NULL or wordless text has no words and the kept text ""; texts shorter than a window keep all; rows
repeated in ``doc_id`` and text are separate occurrences (and so remove each other's windows); a NULL ``doc_id`` is an id
like any other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonday.llm.common import kept

WINDOW, ROUNDS = 35, 6
#: Odd multipliers for hashes modulo 2**64; fixed so that all tasks name alike.
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
#: Characters whose words are named at once, and rows sent on at once. A longer text is a portion of its own.
PORTION, BATCH = 1 << 20, 1 << 16


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX1
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


@dataclass
class Laid:
    """The words of several texts in one array, with a wall before, between and after them."""

    words: list[list[bytes]]
    names: np.ndarray
    starts: np.ndarray
    walls: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Laid:
        h, names, words, starts = xxhash.xxh3_64_intdigest, [0], [], []
        for t in texts:
            words.append(split(t))
            starts.append(len(names))
            names.extend(map(h, words[-1]))
            names.append(0)
        walls = np.zeros(len(names), dtype=bool)
        walls[0] = True
        walls[[s + len(w) for s, w in zip(starts, words, strict=True)]] = True
        return cls(words, np.array(names, dtype=np.uint64), np.array(starts, dtype=np.int64), walls)

    def clear(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of the stretches [low, high) lie within one text."""
        met = np.concatenate(([0], np.cumsum(self.walls)))
        ok = (low >= 0) & (high <= len(self.walls))
        return ok & (met[np.where(ok, high, 0)] == met[np.where(ok, low, 0)])

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def windows(self, window: int) -> np.ndarray:
        """Whether a window within one text starts at each place."""
        at = np.arange(len(self.walls))
        return self.clear(at, at + window)


class Stretches:
    """Hashes of any stretch of a sequence of names, by prefix sums modulo 2**64."""

    def __init__(self, names: np.ndarray, base: int):
        powers = np.full(len(names), np.uint64(base))
        powers[:1] = 1
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * np.multiply.accumulate(powers), dtype=np.uint64)))
        inverse = np.full(len(names) + 1, np.uint64(pow(base, -1, 1 << 64)))
        inverse[:1] = 1
        self.inverse = np.multiply.accumulate(inverse)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mixed((self.sums[high] - self.sums[low]) * self.inverse[low] + (high - low).astype(np.uint64) * MIX2)


def rounds_of(laid: Laid, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols after the run round and each pair round: names, and the stretch [low, high) of words that settles each.

    To settle a run takes the words on either side; to settle that a symbol stays single takes the neighbour that it
    could have merged with. Walls merge with nothing, and a stretch that reaches one is settled in its own text only.
    """
    names, walls, n = laid.names, laid.walls, len(laid.names)
    same = (names[1:] == names[:-1]) & ~walls[1:] & ~walls[:-1]
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    last = np.concatenate((first[1:], [n]))
    long = (last - first).astype(np.uint64)
    names, walls, low, high = np.where(long > 1, mixed(names[first] ^ mixed(long)), names[first]), walls[first], first - 1, last + 1
    yield names, low, high
    for r in range(rounds):
        turn = np.full(1, r + 1, dtype=np.uint64)
        right = (mixed(names + turn * MIX2) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(names), dtype=bool)
        joins[:-1] = ~right[:-1] & right[1:] & ~walls[:-1] & ~walls[1:]
        stays = np.concatenate(([True], ~joins[:-1]))
        following = np.concatenate((names[1:], names[:1]))
        looks_back = right & ~joins
        low = np.minimum(low, np.where(looks_back, np.concatenate(([-1], low[:-1])), np.concatenate((low[1:], [n]))))
        high = np.maximum(high, np.where(looks_back, np.concatenate(([0], high[:-1])), np.concatenate((high[1:], [n + 1]))))
        names = np.where(joins, mixed(names * MIX1 + mixed(following ^ turn)), names)
        names, walls, low, high = names[stays], walls[stays], low[stays], high[stays]
        yield names, low, high


def levels(laid: Laid, window: int, rounds: int) -> Iterator[tuple]:
    """The symbols to count, from the highest round down: so many that every window that can hold one does.

    Each round gives its number, the windows that no higher round's symbol settles, and the names and stretches of its
    symbols in those. Equal windows are settled by equal rounds, whatever text they stand in.
    """
    free = laid.windows(window)
    n = len(free)
    for level, (symbols, low, high) in reversed(list(enumerate(rounds_of(laid, rounds)))):
        short = (high - low <= window) & laid.clear(low, high)
        symbols, low, high = symbols[short], low[short], high[short]
        left, stop = np.maximum(high - window, 0), low + 1
        open_before = np.concatenate(([0], np.cumsum(free)))
        useful = open_before[stop] > open_before[left]
        symbols, low, high, left, stop = symbols[useful], low[useful], high[useful], left[useful], stop[useful]
        yield level, free, symbols, low, high
        free = free & ~held(left, stop, n)
        if not free.any():
            break


def anchors(laid: Laid, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the symbols to count, the place each starts at, and its length and round as length << 8 | round."""
    words, out = Stretches(laid.names, BASES[0]), []
    for level, _, symbols, low, high in levels(laid, window, rounds):
        name = mixed(symbols + np.full(1, level, dtype=np.uint64) * MIX1)
        out.append((name ^ words.of(low, high), low, (high - low) << 8 | level))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def held(left: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges [left, stop)."""
    return np.cumsum(np.bincount(left, minlength=n + 1)[:n] - np.bincount(stop, minlength=n + 1)[:n]) > 0


def survivors(sizes: np.ndarray, places: list, lone: list, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that hold no symbol met once, and where each text starts, texts laid as in :class:`Laid`.

    ``sizes`` are the texts' numbers of words; ``places`` their symbols and ``lone`` those met once, as
    low << 32 | length << 8 | round. A symbol strikes out only windows that its own round settles: elsewhere its twin may
    not have been counted.
    """
    starts = np.cumsum(sizes + 1) - sizes
    n = int(sizes.sum() + len(sizes) + 1)
    walls = np.zeros(n, dtype=bool)
    walls[0] = True
    walls[starts + sizes] = True
    free = Laid([], walls, starts, walls).windows(window)
    alive = free.copy()
    every, struck = (_laid(x, starts) for x in (places, lone))
    for level in sorted(set((every[2]).tolist()), reverse=True):
        alive &= ~(free & _over(struck, level, window, n))
        free &= ~_over(every, level, window, n)
    return np.flatnonzero(alive), starts


def _laid(places: list, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low, length and round of the symbols of all texts, at their places in the laid-out array."""
    found = [np.asarray(x, dtype=np.int64) + (s << 32) for x, s in zip(places, starts.tolist(), strict=True) if x is not None and len(x)]
    every = np.concatenate([np.zeros(0, np.int64), *found])
    return every >> 32, (every >> 8) & 0xFFFFFF, every & 0xFF


def _over(symbols: tuple[np.ndarray, np.ndarray, np.ndarray], level: int, window: int, n: int) -> np.ndarray:
    """The windows that hold a symbol of a round."""
    low, length, of_level = symbols
    mine = of_level == level
    return held(np.maximum(low[mine] + length[mine] - window, 0), low[mine] + 1, n)


def ranges(places: np.ndarray) -> np.ndarray:
    """Ascending places as ranges [from, to), from << 32 | to."""
    if not len(places):
        return places
    ends = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate(([0], ends + 1))] << 32 | places[np.concatenate((ends, [len(places) - 1]))] + 1


def spread(laid: Laid, alive: list) -> np.ndarray:
    """The places, in ``laid``, of each text's ranges."""
    found = [np.asarray(x, dtype=np.int64) + ((s << 32) + s) for x, s in zip(alive, laid.starts.tolist(), strict=True)]
    every = np.concatenate([np.zeros(0, np.int64), *found])
    return np.flatnonzero(held(every >> 32, every & 0xFFFFFFFF, len(laid.walls)))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches, with their texts, that hold about ``PORTION`` characters."""
    for b in batches:
        texts, at, n = b.column("text").to_pylist(), 0, 0
        for i, t in enumerate(texts):
            n += len(t or "")
            if n >= PORTION or i + 1 == len(texts):
                yield b.slice(at, i + 1 - at), texts[at : i + 1]
                at, n = i + 1, 0


def _in_batches(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Numpy or Arrow columns of one length, as batches of bounded size."""
    whole = pa.record_batch([pa.array(c, type=pa.int64()) if isinstance(c, np.ndarray) else c for c in columns], names=names)
    for at in range(0, whole.num_rows, BATCH):
        yield whole.slice(at, BATCH)


def _places(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _portions(batches):
            laid = Laid.of(texts)
            keys, low, form = anchors(laid, window, rounds)
            which = laid.text_of(low)
            own = laid.starts[which]
            yield from _in_batches(
                [keys.view(np.int64), b.column("doc_id").take(pa.array(which)), b.column("row").take(pa.array(which)), (low - own) << 32 | form],
                ["key", "doc_id", "row", "place"],
            )

    return docs.mapInArrow(of, "key long, doc_id long, row long, place long")


def _windows(suspects: DataFrame, window: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _portions(batches):
            laid = Laid.of(texts)
            starts = spread(laid, b.column("alive").to_pylist())
            one, two = (Stretches(laid.names, base).of(starts, starts + window).view(np.int64) for base in BASES)
            which = laid.text_of(starts)
            at = pa.array(which)
            yield from _in_batches([one, two, b.column("doc_id").take(at), b.column("row").take(at), starts - laid.starts[which]], ["key", "key2", "doc_id", "row", "place"])

    return suspects.mapInArrow(of, "key long, key2 long, doc_id long, row long, place long")


def _met_once(places: DataFrame, keys: list[str]) -> DataFrame:
    """For each document row the places whose key occurs nowhere else, as an array ``lone``.

    All aggregates are minima of numbers, so they combine before the shuffle; with one row they are that row.
    """
    once = places.groupBy(*keys).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.min("place").alias("place"))
    return once.where("n = 1").groupBy("doc_id", "row").agg(F.collect_list("place").alias("lone"))


def _with(docs: DataFrame, found: DataFrame, name: str, how: str = "left") -> DataFrame:
    """``docs`` with the last column of ``found``, which has each row once, as ``name``."""
    found = found.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col(found.columns[-1]).alias(name))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (docs["row"] == found["__row"]), how).drop("__id", "__row")


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _facts(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """What a document's windows are judged by: its number of words, its digest, and the places of its symbols."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _portions(batches):
            laid = Laid.of(texts)
            _, low, form = anchors(laid, window, rounds)
            which = laid.text_of(low)
            order = np.argsort(which, kind="stable")
            places = ((low - laid.starts[which]) << 32 | form)[order]
            cuts = np.searchsorted(which[order], np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.record_batch(
                [
                    b.column("doc_id"), b.column("row"), pa.array([len(w) for w in laid.words], type=pa.int64()),
                    pa.array([_sha(w) for w in laid.words], type=pa.string()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(places, type=pa.int64())),
                ],
                names=["doc_id", "row", "n_words", "kept_sha256", "places"],
            )

    return docs.mapInArrow(of, "doc_id long, row long, n_words long, kept_sha256 string, places array<long>")


def _judge(window: int):
    """Each document with the ranges of its surviving windows, NULL where none survives."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column("n_words"), dtype=np.int64)
            for part in _by_words(sizes):
                some = b.slice(part.start, part.stop - part.start)
                left, starts = survivors(sizes[part], some.column("places").to_numpy(zero_copy_only=False), some.column("lone").to_numpy(zero_copy_only=False), window)
                cuts = np.searchsorted(left, np.append(starts, starts[-1] + sizes[part][-1] + 1))
                alive = [ranges(left[i:j] - s) if j > i else None for i, j, s in zip(cuts[:-1], cuts[1:], starts, strict=True)]
                columns = [some.column(c) for c in ("doc_id", "row", "n_words", "kept_sha256")]
                yield pa.record_batch([*columns, pa.array(alive, type=pa.list_(pa.int64()))], names=["doc_id", "row", "n_words", "kept_sha256", "alive"])

    return of


def _by_words(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of texts with about ``PORTION`` words together."""
    slot = np.cumsum(sizes + 1) // PORTION
    cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(sizes)]
    return (slice(i, j) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


def _cut(window: int):
    span = pa.struct([("from", pa.int64()), ("to", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _portions(batches):
            laid = Laid.of(texts)
            repeated = np.zeros(len(laid.walls), dtype=bool)
            repeated[spread(laid, b.column("alive").to_pylist())] = True
            for s, single in zip(laid.starts.tolist(), b.column("single").to_pylist(), strict=True):
                if single:
                    repeated[np.array(single, dtype=np.int64) + s] = False
            starts = np.flatnonzero(repeated)
            gone = held(starts, starts + window, len(repeated))
            out = []
            for words, s in zip(laid.words, laid.starts.tolist(), strict=True):
                off = gone[s : s + len(words)]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], off.astype(np.int8), [0])))).reshape(-1, 2).tolist()
                left = [w for w, g in zip(words, off.tolist(), strict=True) if not g]
                out.append((len(words), int(off.sum()), [{"from": x, "to": y} for x, y in edges], b" ".join(left).decode() if edges else None, _sha(left)))
            kinds = [pa.int64(), pa.int64(), pa.list_(span), pa.string(), pa.string()]
            columns = [pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.record_batch([b.column("doc_id"), *columns], names=["doc_id", "n_words", "n_removed", "removed", "kept_text", "kept_sha256"])

    return of


JUDGED = "doc_id long, row long, n_words long, kept_sha256 string, alive array<long>"
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<from:long,to:long>>, kept_text string, kept_sha256 string"


def kept_words(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``removed`` (ranges [from, to) of words), ``kept_text``.

    ``kept_text`` is NULL where nothing is removed; the text itself is kept then. ``kept_sha256`` is that of the kept
    words joined by one space, in either case.
    """
    # a row is known by its id and 64 bits of its text, so only rows of one id (or none) could ever be mistaken
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")
    lone = _met_once(_places(docs, window, rounds), ["key"])
    judged = kept(_with(_facts(docs, window, rounds), lone, "lone").mapInArrow(_judge(window), JUDGED), "judged")
    # rows repeated in id and text have the same windows
    suspects = judged.where("alive is not null").select("doc_id", "row", "alive").dropDuplicates(["doc_id", "row"])
    texts = _with(docs, suspects, "alive", "inner")
    single = _met_once(_windows(texts, window), ["key", "key2"])
    cleaned = _with(texts, single, "single").drop("row").mapInArrow(_cut(window), RESULT)
    whole = judged.where("alive is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<from:long,to:long>>").alias("removed"),
        F.lit(None).cast("string").alias("kept_text"), "kept_sha256",
    )
    return whole.unionByName(cleaned)
