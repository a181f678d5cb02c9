"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.store import dropped, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps (a published MapReduce method): each step links
    neighbourhoods to their smallest member, so hubs shrink instead of being gathered, and the
    number of rounds grows with the logarithm of the longest chain. Both steps of a round are
    stored: in one plan, the first would be computed, and kept track of by the driver, three times.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc")
    mark = _mark(current)
    while True:
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        dropped(current, large)
        before, mark, current = mark, _mark(following), following
        # Done when every edge of the round before is still there and nothing is new.
        if mark == before:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Tells tables of distinct edges apart, by their size and two 64-bit sums of hashes."""
    sums = [F.bit_xor(F.xxhash64("u", "v", F.lit(i))) for i in range(2)]
    return tuple(edges.agg(F.count("*"), *sums).first())
