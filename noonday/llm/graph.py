"""Connected components of an edge table by alternating star contraction, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonday.llm.common import kept


def _marked(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum of an edge table."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node reachable, for every node of ``edges`` (columns ``u``, ``v``, one number type).

    A large star hangs each node's larger neighbours on the least node of its neighbourhood, a small star its smaller
    ones; the rounds grow with the logarithm of the nodes. The least neighbours are a written table, so the join that
    follows is between two plain shuffles and adaptive execution can split the edges of a hub.
    """
    edges = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (now := _marked(edges)) != before and now[0]:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "stars")
        large = kept(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
