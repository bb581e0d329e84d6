"""SimHash near-dedup by pigeonhole blocks.

A document's fingerprint has a bit set where over half of its shingles' 64-bit hashes have it. Fingerprints that differ
in at most ``bits`` places are linked. The 64 bits are cut into ``bits + 3`` blocks, so a close pair agrees on at least
three whole blocks; every choice of three is a table of keys, equal keys are joined, and the Hamming distance is verified
in the join. A pair is given out by the first table it meets in only. Copies never make pairs: fingerprints are grouped
first, and only different ones are joined.

A key with more than ``bucket`` different fingerprints is not joined pair by pair. All fingerprints of such keys go
through an exact way whose rows grow in proportion to them: two fingerprints are within 3 bits exactly if some value is
within 1 bit of the one and 2 bits of the other, so all within 2 bits of a value that has anyone within 1 bit are in one
component. Each of them is tied to that value's least fingerprint.

Defined cases: a NULL or wordless text has the fingerprint zero and is linked like any other; fewer words than a shingle
are one shingle; a NULL ``doc_id`` is never the component's id unless all its ids are NULL; repeated rows are in one
component; an empty table gives no rows; further columns are ignored (``components_of``) or passed through (``one_of_each``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from noonday.llm.common import chosen, kept, packed_rows
from noonday.llm.graph import components

SHINGLE, BITS, BUCKET, SEED = 3, 3, 512, 42
#: Shingles whose bits are counted at once; bounds the memory that a very long text takes.
AT_ONCE = 1 << 15


def fingerprint(text: str | None, words_each: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text. Bytes lower-case and split by the ASCII rules alone."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    each = min(words_each, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed, n = xxhash.xxh64_intdigest, len(words) - each + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, AT_ONCE):
        spans = zip(starts[at : min(at + AT_ONCE, n)].tolist(), ends[at + each - 1 : min(at + AT_ONCE, n) + each - 1].tolist())
        h = np.array([hashed(line[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, words_each: int = SHINGLE) -> Column:
    """Fingerprints as signed longs."""

    @pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words_each) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def _masks(bits: int) -> list[int]:
    """One mask per choice of three out of ``bits + 3`` blocks."""
    cuts = [round(64 * i / (bits + 3)) for i in range(bits + 4)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(cuts)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(three)) for three in itertools.combinations(blocks, 3)]


def near_pairs(prints: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``u``, ``v`` between different values of ``fp`` that give the components of all links of ``bits`` or fewer.

    Below the bucket bound they are all the links; from it on, ties to a common neighbour.
    """
    masks = _masks(bits)
    keys = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    crowded = kept(keys.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("t", "key"), "crowded")
    none = crowded.isEmpty()
    few = keys if none else keys.join(crowded, ["t", "key"], "left_anti")
    a, b = few.alias("a"), few.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= bits)
    near = near & (first == F.col("a.t")) if none else near
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key"))
    pairs = a.join(b, same & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    return pairs if none else pairs.union(_star_edges(keys.join(crowded, ["t", "key"], "left_semi").select("fp").distinct(), bits))


def _star_edges(prints: DataFrame, bits: int) -> DataFrame:
    """Edges that connect what is within ``bits`` of each other, a bounded number of rows for each fingerprint.

    Half of ``bits``, rounded down, is turned on the near side and the rest on the far side.
    """
    prints = kept(prints, "crowd")
    near, far = (_turned(prints, n) for n in (bits // 2, bits - bits // 2))
    hubs = near.groupBy("z").agg(F.min("fp").alias("hub"))
    return far.join(hubs, "z").where("fp <> hub").select(F.greatest("fp", "hub").alias("u"), F.least("fp", "hub").alias("v")).distinct()


def _turned(prints: DataFrame, most: int) -> DataFrame:
    """Every value ``z`` within ``most`` bits of each ``fp``."""
    out = prints.select("fp", F.col("fp").alias("z"), F.lit(-1).alias("last"))
    for _ in range(most):
        step = F.explode(F.concat(F.array(F.lit(64)), F.when(F.col("last") < 63, F.sequence(F.col("last") + 1, F.lit(63))).otherwise(F.array().cast("array<int>"))))
        out = out.withColumn("p", step).where("p < 64 or last < 64").select(
            "fp", F.expr("z ^ if(p < 64, shiftleft(1L, p), 0L)").alias("z"), F.col("p").alias("last")
        )
    return out.select("fp", "z").distinct()


def _classes(rows: DataFrame, bits: int, bucket: int) -> DataFrame:
    """``fp``, ``root`` (one value for each component) and ``component_id`` for every fingerprint of ``rows``."""
    prints = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    joined = kept(components(near_pairs(prints.select("fp"), bits, bucket)), "components")
    met = prints.join(joined, prints["fp"] == joined["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = met.groupBy("root").agg(F.min("low").alias("component_id"))
    return kept(met.join(ids, "root").select("fp", "root", "component_id"), "classes")


def components_of(docs: DataFrame, words_each: int = SHINGLE, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (its least ``doc_id``)."""
    rows = kept(docs.select("doc_id", fingerprints(F.col("text"), words_each).alias("fp")), "fingerprints")
    classes = _classes(rows, bits, bucket)
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def one_of_each(docs: DataFrame, words_each: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with their columns, one for each component: a row with its least ``doc_id``.

    A row is known by its ``doc_id`` and its text's SHA-256, so unlike texts without an id or with the same id stay apart.
    Texts move once, by that key.
    """
    rows = kept(docs.select("doc_id", _sha(F.col("text")).alias("sha"), fingerprints(F.col("text"), words_each).alias("fp")), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("first")
    met = rows.groupBy("fp").agg(first).join(_classes(rows, bits, BUCKET), "fp")
    one = kept(met.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.sha"), "staying")
    return chosen(packed_rows(docs, doc_id=F.col("doc_id"), sha=_sha(F.col("text"))), one, "doc_id", "sha").select("row.*")
