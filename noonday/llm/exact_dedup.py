"""Exact dedup by content-defined chunk recipes.

Each text is cut where its own content says so (at a line or sentence end after a least length), so equal stretches give
equal chunks wherever they stand. A chunk's identifier is a 64-bit hash, verified with SHA-256: an identifier whose
occurrences have more than one SHA-256 is not trusted, and recipes that hold it carry the SHA-256 values too. Two texts
are equal when their ordered identifier lists are. Texts are read once and never shuffled; only recipes move.

Defined cases: a NULL text counts as empty; the empty text has the empty recipe and is a group like any other; rows with
the same ``doc_id`` and text are separate rows of one group, of which one stays; a NULL ``doc_id`` is below every number;
an empty table gives no rows; further columns are ignored by ``find_copies`` and passed through by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonday.functions.plan import computed_once
from noonday.llm.common import ascii_lower, chosen, kept, packed_rows

LEAST, MOST = 1024, 8192


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """The shortest stretch of ``least`` to ``most`` characters up to a line or sentence end; else ``most``; else the rest."""
    return rf"(?s).{{{least},{most - 1}}}?(?:\n|[.!?]\x20|\z)|.{{{most}}}|.+"


def recipes(docs: DataFrame, text: Column, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One narrow row per document: ``uid``, ``doc_id``, ``text_sha256`` and ``recipe``, an ordered list of (id, sha)."""
    normal = computed_once(docs.select("doc_id", ascii_lower(F.coalesce(text, F.lit(""))).alias("normal")))
    parts = F.regexp_extract_all("normal", F.lit(chunk_pattern(least, most)), F.lit(0))
    return normal.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        F.sha2("normal", 256).alias("text_sha256"),
        F.transform(parts, lambda c: F.struct(F.xxhash64(c).alias("id"), F.sha2(c, 256).alias("sha"))).alias("recipe"),
    )


def find_copies(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per document: ``doc_id``, ``text_sha256``, ``keep_id``, ``group_size``, ``kept``, ``n_chunks``."""
    rows = kept(recipes(docs, F.col("text"), least, most), "recipes")
    chunks = rows.select("uid", F.explode("recipe").alias("c")).select("uid", "c.id", "c.sha")
    seen = chunks.groupBy("id").agg(F.min("sha").alias("low"), F.max("sha").alias("high"))
    doubtful = kept(seen.where("low <> high").select("id"), "doubtful")
    unsure = chunks.join(doubtful, "id", "left_semi").select("uid").distinct().withColumn("unsure", F.lit(True))
    none = F.array().cast("array<string>")
    lists = rows.join(unsure, "uid", "left").select(
        "uid", "doc_id", "text_sha256", F.size("recipe").cast("long").alias("n_chunks"), F.col("recipe.id").alias("ids"),
        F.when(F.col("unsure"), F.col("recipe.sha")).otherwise(none).alias("shas"),
    )
    groups = kept(
        lists.groupBy("ids", "shas").agg(F.max(F.struct("doc_id", "uid")).alias("stays"), F.count("*").alias("group_size"))
        .where("group_size > 1"),
        "copies",
    )
    found = lists.join(groups, ["ids", "shas"], "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("stays.uid"))).alias("kept"),
        "text_sha256",
        "n_chunks",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of rows equal in ``doc_id`` and text one stays."""
    staying = find_copies(docs).where("kept").select("doc_id", F.col("text_sha256").alias("sha")).distinct()
    sha = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    return chosen(packed_rows(docs, doc_id=F.col("doc_id"), sha=sha), kept(staying, "staying"), "doc_id", "sha").select("row.*")
