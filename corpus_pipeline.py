"""From raw documents to packed token sequences: five stages, each one operator of ``noonday.llm``.

Every stage reads what the stage before it has written, and its decisions take effect: documents that the classifier
scores under 0.5 go; of equal texts the one with the largest ``doc_id`` stays; of documents whose fingerprints are linked
the one with the least ``doc_id`` stays; sources are brought to their weights, by leaving out or repeating whole
documents; the rest is packed. All stages but the last return the columns of ``documents``.

Defined cases are those of the operators. Rows equal in ``doc_id`` and text count as copies of one document, further
columns are passed through up to the last stage, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noonday.llm import exact_dedup, mixing, packing, quality, simhash
from noonday.llm.common import kept, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles and distance are those of the operator's query: three words, three bits."""
    return simhash.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids; a document that the mix repeats comes once for each time."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: SQL has no tokenizer and no XXH64; the tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
