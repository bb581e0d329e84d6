"""Best-fit packing of documents into as few sequences as possible, by bin completion with branch and bound.

Only documents longer than a sequence are cut, into full pieces and a last one. The pieces are dealt into blocks of about
``PIECES`` by a hash of their key; each block is packed on its own. The first solution is best-fit decreasing; a search then
tries to save a sequence: it takes the largest piece left, enumerates the fillings around it, leaves out those that another
one dominates (its pieces could be swapped for the other's), and branches on the rest, least waste first. A branch ends
where its waste leaves no room for a better solution, the block's search where the lower bound is reached or after
``NODES`` fillings. Every solution found becomes the incumbent, so a search cut short still gives a whole packing.

A block's waste stands in few of its sequences, so in a second round the sequences with much room are dealt anew, whole,
into blocks of their own; where that saves nothing, their first packing stays. What is lost against one block for all is so
under one sequence for ``PIECES`` pieces of the second round.

Texts are tokenized once. Rows move with a piece's length and number, ids only where they are asked for.

Defined cases: a NULL or empty text is the end token alone; repeated rows are separate documents; a text of any length is cut
whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonday.llm.common import kept

VOCABULARY, END, LENGTH = "word_bpe_49k", 1, 4096
#: Pieces of a block; fillings that a block's search tries; fillings of one sequence to branch on and steps to find them.
PIECES, NODES, BRANCHES, STEPS = 4096, 4000, 6, 200
#: In the second round are sequences with at least one ``LOOSE``-th of their length empty.
LOOSE = 64
#: Bytes of text that a task encodes at a time.
BATCH = 1 << 24
#: The vocabulary's end of word, and the character that stands for it. Fixed by the tokenizer file: its cut of words into pieces.
SUFFIX, MARK = "</w>", "\x01"
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-zß-öø-ÿ0-9]+")
#: Words whose lower case and pieces are the same for the tokenizer and for Python.
FAST = re.compile("[!-~À-ÿ]+")


class Encoder:
    """The ids of whole texts, with the end token.

    The tokenizer drops white space and never joins across it, so texts are cut into words and each different word of a
    batch is encoded once. Words of ASCII and Latin letters are encoded together by the same vocabulary as ranks, with
    ``MARK`` for the vocabulary's end of word; all others, and those that may hold a special token, by the tokenizer file.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path(f"{vocabulary}.json")
        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256 and what follows
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in printed]
        byte = {chr(x): x for x in printed} | {chr(256 + i): x for i, x in enumerate(others)}
        ranks = {}
        for token, rank in vocab.items():
            body = token.removesuffix(SUFFIX)
            if body and all(c in byte for c in body):
                ranks[bytes(byte[c] for c in body) + MARK.encode() * (body != token)] = rank
        self.newline = ranks[b"\n"]
        self.fast = tiktoken.Encoding(vocabulary, pat_str=rf"[^{MARK}\n]+{MARK}|\n", mergeable_ranks=ranks, special_tokens={})

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and the number of each word's."""
        plain = [bool(w) and FAST.fullmatch(w) is not None and "<|" not in w for w in words]
        joined = PIECE.sub(rf"\g<0>{MARK}", "".join(f"{w}\n" for w, p in zip(words, plain, strict=True) if p).lower())
        fast = np.asarray(self.fast.encode_ordinary(joined), dtype="<u4")
        ends = np.flatnonzero(fast == self.newline)
        slow = [e.ids for e in self.plain.encode_batch([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False)]
        which, count = np.array(plain, dtype=bool), np.zeros(len(words), dtype=np.int64)
        count[which] = np.diff(ends, prepend=-1) - 1
        count[~which] = [len(x) for x in slow]
        ids = np.empty(count.sum(), dtype="<u4")
        of_fast = np.repeat(which, count)
        ids[of_fast] = fast[fast != self.newline]
        ids[~of_fast] = np.fromiter(chain.from_iterable(slow), dtype="<u4")
        return ids, count

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        ids, count = self._each(coded.dictionary.to_pylist())
        first, word = np.concatenate(([0], np.cumsum(count))), coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(count[word])))
        every = ids[np.repeat(first[word] - ends[:-1], count[word]) + np.arange(ends[-1])]
        edge = ends[np.asarray(split.offsets) - split.offsets[0].as_py()]
        for start, stop in zip(edge, edge[1:], strict=False):
            yield np.append(every[start:stop], np.array([END], dtype="<u4"))


@lru_cache(maxsize=1)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(vocabulary)


def _few(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BATCH`` bytes of text; a longer text is one on its own."""
    sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
    slot = (np.cumsum(sizes) - 1) // BATCH
    cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), b.num_rows]
    return (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


def _cut(vocabulary: str, length: int, with_ids: bool):
    names = ["key", "doc_id", "piece", "start", "length", "ids_crc32"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key = encoder(vocabulary), TaskContext.get().partitionId() << 40
        for b in batches:
            for part in _few(b):
                rows, ids = [], []
                for doc_id, found in zip(part.column("doc_id").to_pylist(), encode(part.column("text")), strict=True):
                    for piece, start in enumerate(range(0, len(found), length)):
                        own = found[start : start + length]
                        rows.append((key, doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
                        key += 1
                        if with_ids:
                            ids.append(own.astype(np.int32))
                kinds = [pa.int32() if n == "piece" else pa.int64() for n in names]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    return of


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """A written table: ``key``, ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``)."""
    kinds = "key long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kept(rows.mapInArrow(_cut(vocabulary, length, with_ids), kinds), "pieces")


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Best-fit decreasing: each piece into the fullest sequence that still has room for it."""
    open_: list[tuple[int, int]] = []  # (room left, sequence), sorted
    out: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        at = bisect_left(open_, (x, -1))
        if at < len(open_):
            left, k = open_.pop(at)
        else:
            left, k = room, len(out)
            out.append([])
        out[k].append(x)
        if left > x:
            insort(open_, (left - x, k))
    return out


def lower_bound(lengths: list[int], room: int) -> int:
    """Sequences needed at least: pieces too long for each other, and the others in what those leave (the bound L2)."""
    x = np.sort(np.asarray(lengths))
    if not len(x):
        return 0
    total = np.concatenate(([0], np.cumsum(x)))
    half = np.searchsorted(x, room / 2, side="right")
    least = np.unique(np.concatenate(([0], x[:half])))  # pieces under this length are left out
    alone = np.searchsorted(x, room - least, side="right")  # from here on nothing fits beside
    first = np.searchsorted(x, least, side="left")
    paired, small = alone - half, total[half] - total[first]
    spare = paired * room - (total[alone] - total[half])
    return int((len(x) - half + np.maximum(0, -(-(small - spare) // room))).max())


def dominates(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the pieces of ``other`` fit into spaces of the sizes of the pieces of ``one``."""
    if not other:
        return True
    x, rest, tried = other[0], other[1:], set()
    for i, space in enumerate(one):
        if space >= x and space not in tried:
            tried.add(space)
            if dominates((*one[:i], space - x, *one[i + 1 :]), rest):
                return True
    return False


class Stock:
    """The pieces left, by length."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
        self.kinds = sorted(self.count)

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            del self.kinds[bisect_left(self.kinds, x)]

    def put(self, x: int) -> None:
        self.count[x] += 1
        if self.count[x] == 1:
            insort(self.kinds, x)

    def fillings(self, room: int, waste: int) -> list[tuple[int, ...]]:
        """Undominated sets of pieces for ``room``, none of which leaves more than ``waste``; the least waste first."""
        if self.count.get(room):
            return [(room,)]  # dominates all others
        found: list[tuple[int, tuple[int, ...]]] = []
        steps = 0

        def grow(left: int, top: int, taken: tuple[int, ...]) -> None:
            nonlocal steps
            i, more = bisect_right(self.kinds, min(left, top)) - 1, False
            while i >= 0 and steps < STEPS:
                x = self.kinds[i]
                if taken.count(x) < self.count[x]:
                    more, steps = True, steps + 1
                    grow(left - x, x, (*taken, x))
                i -= 1
            if not more and left <= waste and not any(left >= k and taken.count(k) < self.count[k] for k in self.kinds[: bisect_right(self.kinds, left)]):
                found.append((left, taken))

        grow(room, room, ())
        out: list[tuple[int, ...]] = []
        for _, taken in sorted(found):
            if len(out) == BRANCHES:
                break
            if not any(dominates(o, taken) for o in out):
                out.append(taken)
        return out


def complete(lengths: list[int], room: int, incumbent: list[list[int]] | None = None, nodes: int = NODES) -> list[list[int]]:
    """The pieces' lengths by sequence: bin completion from the better of best fit and ``incumbent``."""
    best = best_fit(lengths, room)
    if incumbent is not None and len(incumbent) <= len(best):
        best = incumbent
    least, total = lower_bound(lengths, room), sum(lengths)
    stock, done, wasted = Stock(lengths), [], 0
    trail: list[list[tuple[int, ...]]] = []  # of each sequence begun, the fillings not tried yet
    forward = True
    while len(best) > least and nodes > 0:
        spare = (len(best) - 1) * room - total - wasted  # what may yet be wasted by a better solution
        if forward and not stock.kinds:
            best = [list(d) for d in done]
            forward = False
            continue
        if forward and len(done) + 1 < len(best):
            top = stock.kinds[-1]
            stock.take(top)
            options = stock.fillings(room - top, spare) if top < room else [()]
            stock.put(top)
            trail.append([(top, *o) for o in reversed(options)])
        elif forward:
            forward = False
            continue
        else:
            if not done:
                break
            undone = done.pop()
            wasted -= room - sum(undone)
            for x in undone:
                stock.put(x)
            spare = (len(best) - 1) * room - total - wasted
        while trail[-1]:
            chosen = trail[-1].pop()
            if room - sum(chosen) <= spare:
                break
        else:
            trail.pop()
            forward = False
            if not trail:
                break
            continue
        nodes -= 1
        for x in chosen:
            stock.take(x)
        done.append(chosen)
        wasted += room - sum(chosen)
        forward = True
    return best


def _assigned(lengths: np.ndarray, filled: list[list[int]], room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, place and the sequence's waste of each piece, the pieces of a length taken in the order they stand in."""
    order = np.argsort(lengths, kind="stable")
    slots = sorted((x, k, at) for k, found in enumerate(filled) for x, at in zip(found, np.cumsum([0, *found[:-1]]).tolist(), strict=True))
    used = [room - sum(found) for found in filled]
    bins, offset, waste = (np.empty(len(lengths), dtype=np.int64) for _ in range(3))
    for row, (_, k, at) in zip(order, slots, strict=True):
        bins[row], offset[row], waste[row] = k, at, used[k]
    return bins, offset, waste


def _packed(room: int, nodes: int):
    def of(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("key")
        lengths = block["length"].to_numpy()
        old = block.groupby(["block", "bin"])["length"].agg(list).tolist() if block["bin"].iloc[0] >= 0 else None
        block["bin"], block["offset"], block["waste"] = _assigned(lengths, complete(lengths.tolist(), room, old, nodes), room)
        block["block"] = block["dealt"]
        return block.drop(columns="dealt")

    return of


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, with_ids: bool = True, block: int = PIECES, nodes: int = NODES) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``)."""
    written = pieces(docs, length, vocabulary, with_ids)
    narrow = written.drop("ids")
    none = [F.lit(-1).cast("long").alias(c) for c in ("block", "bin", "offset", "waste")]
    kinds = "key long, doc_id long, piece int, start long, length long, ids_crc32 long, block long, bin long, offset long, waste long"

    def dealt(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        blocks = max(1, -(-rows.count() // block))
        to = rows.withColumn("dealt", F.pmod(F.xxhash64(*by), F.lit(blocks)))
        return kept(to.groupBy("dealt").applyInPandas(_packed(length, nodes), kinds), name)

    first = dealt(narrow.select("*", *none), ["key"], "packed")
    loose = F.col("waste") * LOOSE >= length
    again = dealt(first.where(loose), ["block", "bin"], "repacked")
    placed = first.where(~loose).withColumn("round", F.lit(0)).unionByName(again.withColumn("round", F.lit(1)))
    sequence = (F.col("block") * 2 + F.col("round")) * (1 << 24) + F.col("bin")
    found = placed.select("key", "doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")
    if with_ids:
        found = found.join(written.select("key", "ids"), "key")
    return found.drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed rows: ``sequence_id``, ``input_ids`` and the ``doc_ids`` of their pieces, in order."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("input_ids"), F.col("p.doc_id").alias("doc_ids"))
