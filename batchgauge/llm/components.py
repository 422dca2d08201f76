"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchgauge.session import materialise

ROUNDS = 60
"""The number of rounds grows with the logarithm of the longest path; this is only a guard."""


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` (long) to ``node``, ``component``: the smallest node reachable.

    Nodes that no edge names get no row; loops, repeated and null edges are ignored. Every round
    links the neighbours of a node to the smallest of them. Minima combine before the shuffle, so a
    node with very many edges is one row per task there; the join that hands the minimum back is
    left to the skew handling of adaptive execution. Each round is written to the shared folder.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = materialise(pairs), None
    for _ in range(ROUNDS):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # a row's own node goes to its minimum once, its other neighbours as well
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        ).where("u <> v").distinct()
        pairs = materialise(small)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
    raise RuntimeError(f"no stable components after {ROUNDS} rounds")
