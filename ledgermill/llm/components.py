"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on narrow rows, so neither edges nor
labels leave the executors; each round is written to the shared folder.  The number
of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.shared import stored


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest node reachable.

    ``edges`` has two columns of ids in any order; loops, repeats and nulls are ignored.
    """
    a, b = (F.col(c) for c in edges.columns)
    star = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        now = star.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(star.select(F.col("v"), F.col("v")).distinct())
        before = now
        both = star.union(star.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        star = stored(small.distinct(), name)
