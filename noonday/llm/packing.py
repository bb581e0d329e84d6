"""Mixture-controlled packing of token sequences.

Every source is a queue of tokens. Windows of ``window`` tokens are filled by deficit round-robin: at each window a queue
earns its share of the whole table's tokens, takes the whole tokens it has earned, and carries the fraction on as its
deficit; the queues are visited in turn and serve their documents in order, cutting where the earning ends. All queues
run dry together, so every window holds the table's proportions to one token per source. With T tokens in a queue and K
windows the earnings up to window k are floor(T k / K), so a task needs only the position of its documents in their
queue to serve them; a queue's position at the start of each partition comes from one sum per partition and source.
Windows one after the other are one stream, cut into sequences of ``length`` tokens: only the last one has padding.

Texts are tokenized once, ids are written once and never shuffled.

Defined cases: a NULL or empty text is the end token alone; NULL is a source of its own; repeated rows are separate
documents; an empty table gives no rows; further columns are ignored. Each source has its own queue, however many there
are: up to ``QUEUES`` totals each task works the windows' edges out itself, above that they are a table joined by queue, with
the same result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noonday.llm.common import kept

VOCABULARY, END, LENGTH, WINDOW, QUEUES = "byte_bpe_50k", 1, 2048, 32 * 2048, 1024
#: Windows whose tokens are summed in one group of the edges' table.
WINDOWS_EACH = 4096
#: Tokens of the batches that a task sends on.
BATCH = 1 << 20
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=1)
def _encoders(vocabulary: str):
    """The vocabulary as ranks, which encode several times faster, and as the tokenizer file, for its special token."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def encode(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids of the tokenizer file, without added special tokens, and the end token."""
    fast, plain = _encoders(vocabulary)
    text = text or ""
    ids = plain.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)
    return np.array([*ids, END], dtype=np.int32)


IDS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("queue", pa.string()), ("n", pa.int64()), ("ahead", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _tokenize(vocabulary: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ahead = TaskContext.get().partitionId(), {}

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            doc_ids, queues, n, before, ids = zip(*rows, strict=True)
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            columns = [pa.array([part] * len(rows), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(queues, pa.string()), pa.array(n, pa.int64()), pa.array(before, pa.int64()), lists]
            return pa.record_batch(columns, schema=IDS)

        rows, size = [], 0
        for b in batches:
            for doc_id, queue, text in zip(*(b.column(c) for c in ("doc_id", "queue", "text")), strict=True):
                ids, queue = encode(text.as_py(), vocabulary), queue.as_py()
                rows.append((doc_id.as_py(), queue, len(ids), ahead.get(queue, 0), ids))
                ahead[queue] = ahead.get(queue, 0) + len(ids)
                size += len(ids)
                if size >= BATCH:
                    yield sent(rows)
                    rows, size = [], 0
        if rows:
            yield sent(rows)

    return of


def tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """A written table: ``doc_id``, ``queue``, ``ids``, their number ``n``, and how many are ``ahead`` of them in ``part``."""
    queue = F.concat(F.lit("s"), F.col("source"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(queue, F.lit("")).alias("queue"), "text")
    return kept(named.mapInArrow(_tokenize(vocabulary), "part int, doc_id long, queue string, n long, ahead long, ids array<int>"), "tokens")


class Turns:
    """Where each queue's tokens come to stand: ``totals`` are the queues' tokens, in the order of their turns."""

    def __init__(self, totals: list[int], window: int):
        self.totals, self.windows, self.edges = totals, max(1, -(-sum(totals) // window)), {}

    def earned(self, k: int) -> list[int]:
        if k not in self.edges:
            if len(self.edges) > 4096:
                self.edges.clear()
            self.edges[k] = [t * k // self.windows for t in self.totals]
        return self.edges[k]

    def served(self, queue: int, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """The stretches [from, to) of the queue's tokens start to stop, each with its place in the stream."""
        while start < stop:
            k = ((start + 1) * self.windows - 1) // self.totals[queue]
            now, then = self.earned(k), self.earned(k + 1)
            to = min(stop, then[queue])
            yield start, to, sum(then[:queue]) + sum(now[queue:]) + start - now[queue]
            start = to


def _cut(spans_of, length: int, with_ids: bool):
    """Pieces of the stretches that ``spans_of`` gives for each batch: for each row (from, to, place), from its first id on."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_in = spans_of()
        for b in batches:
            doc_ids, out, pieces = b.column("doc_id").to_pylist(), [], []
            for i, (spans, ids) in enumerate(zip(spans_in(b), b.column("ids"), strict=True)):
                ids = np.asarray(ids.values, dtype="<u4")
                for start, to, place in spans:
                    while start < to:
                        n = min(to - start, length - place % length)
                        piece = ids[start : start + n]
                        out.append((doc_ids[i], start, n, zlib.crc32(piece.tobytes()), len(ids), place // length, place % length))
                        if with_ids:
                            pieces.append(piece.astype(np.int32))
                        start, place = start + n, place + n
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(names)
            extra = [pa.array(pieces, pa.list_(pa.int32()))] if with_ids else []
            yield pa.record_batch([*columns, *extra], names=names + ["ids"] * with_ids)

    return of


def _by_turns(queues: dict[str, int], totals: list[int], window: int):
    def spans_of():
        turns = Turns(totals, window)

        def spans_in(b: pa.RecordBatch) -> Iterator[list[tuple[int, int, int]]]:
            for queue, first, ids in zip(b.column("queue").to_pylist(), b.column("first").to_pylist(), b.column("ids"), strict=True):
                yield [(start - first, to - first, place) for start, to, place in turns.served(queues[queue], first, first + len(ids))]

        return spans_in

    return spans_of


def _by_table():
    def spans_in(b: pa.RecordBatch) -> Iterator[list[tuple[int, int, int]]]:
        for spans in b.column("spans"):
            yield [(x["start"].as_py(), x["to"].as_py(), x["place"].as_py()) for x in spans]

    return spans_in


def _edges(totals: DataFrame, windows: int) -> DataFrame:
    """``queue``, ``k``, ``lo``, ``hi``, ``place``: the tokens that each queue serves in window ``k``, and where they begin.

    Only windows in which the queue serves a token are rows, so there are no more of them than pieces.
    """
    n = F.lit(windows)
    served = totals.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("t", n.cast("long")) - 1)))
    # a queue with fewer tokens than windows serves one token in some of them
    one = F.expr(f"cast((cast(j + 1 as decimal(20,0)) * {windows} - 1) div t as long)")
    at = served.select("queue", "t", F.when(F.col("t") < n, one).otherwise(F.col("j")).alias("k"))
    earned = lambda k: F.expr(f"(t div {windows}) * ({k}) + ((t % {windows}) * ({k})) div {windows}")
    rows = kept(at.select("queue", "k", earned("k").alias("lo"), earned("k + 1").alias("hi")), "edges")
    cut = f"k div {WINDOWS_EACH}"
    sums = rows.groupBy(F.expr(cut).alias("c"), "k").agg(F.sum(F.expr("hi - lo")).alias("d"))
    parts = sums.groupBy("c").agg(F.sum("d").alias("d"))
    up_to = lambda w: F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("c", up_to(Window.orderBy("c")).alias("before"))
    opens = sums.withColumn("inner", up_to(Window.partitionBy("c").orderBy("k"))).join(bases, "c").select("k", (F.col("before") + F.col("inner")).alias("opens"))
    turn = Window.partitionBy("k").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.expr("hi - lo")).over(turn), F.lit(0))
    return rows.withColumn("ahead", ahead).join(opens, "k").select("queue", "k", "lo", "hi", (F.col("opens") + F.col("ahead")).alias("place"))


def _spans(placed: DataFrame, totals: DataFrame, windows: int) -> DataFrame:
    """``placed`` (whose ``queue`` and ``first`` are unique) with ``spans``, the stretches of each row's ids in the stream."""
    rows = placed.select("queue", "first", (F.col("first") + F.size("ids")).alias("last")).join(totals, "queue")
    k = lambda token: f"cast((cast({token} + 1 as decimal(20,0)) * {windows} - 1) div t as long)"
    whole = F.expr(f"sequence({k('first')}, {k('last - 1')})")
    single = F.expr(f"transform(sequence(first, last - 1), x -> {k('x')})")
    reached = rows.select("queue", "first", "last", F.explode(F.when(F.col("t") < windows, single).otherwise(whole)).alias("k"))
    start, to = F.greatest("first", "lo"), F.least("last", "hi")
    met = reached.join(_edges(totals, windows), ["queue", "k"]).select(
        "queue", "first", F.struct((start - F.col("first")).alias("start"), (to - F.col("first")).alias("to"), (F.col("place") + start - F.col("lo")).alias("place")).alias("span")
    )
    spans = kept(met.groupBy("queue", "first").agg(F.sort_array(F.collect_list("span")).alias("spans")), "spans")
    return placed.join(spans, ["queue", "first"]).select("doc_id", "ids", "spans")


def pack(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (and ``ids``)."""
    written = tokens(docs, vocabulary)
    sums = kept(written.groupBy("queue", "part").agg(F.sum("n").alias("n")), "sums")
    totals = kept(sums.groupBy("queue").agg(F.sum("n").alias("t")), "totals")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept(sums.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    placed = written.join(starts, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("ahead")).alias("first"), "ids")
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    found = totals.agg(F.count("*").alias("queues"), F.sum("t").alias("tokens")).first()
    if found["queues"] > QUEUES:
        spans = _spans(placed, totals, max(1, -(-found["tokens"] // window)))
        return spans.mapInArrow(_cut(lambda: _by_table(), length, with_ids), kinds)
    few = {r["queue"]: r["t"] for r in totals.collect()}  # QUEUES rows at most
    order = sorted(few)
    turns = _by_turns({q: i for i, q in enumerate(order)}, [few[q] for q in order], window)
    return placed.mapInArrow(_cut(turns, length, with_ids), kinds)


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The packed rows: ``sequence_id``, ``input_ids`` and the ``doc_ids`` of their pieces, in order; at most ``length`` ids."""
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("input_ids"), F.col("p.doc_id").alias("doc_ids"))
