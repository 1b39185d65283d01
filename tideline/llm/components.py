"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a, b: long), component its smallest vertex.

    Each round links every vertex to the smallest vertex it knows, first among
    larger and then among smaller neighbours, until nothing changes: a number
    of rounds logarithmic in the graph's size. Only minima are aggregated, so a
    vertex with very many neighbours costs no more than partial aggregation,
    and every round is a written table.
    """
    oriented = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    now = scratch.keep(oriented.distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            break
        before = state
    leaves = now.select(F.col("u").alias("v"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v"), F.col("v").alias("component")).distinct())
