"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a few joins and aggregations over the edges alone, written to the checkpoint folder; the number
of rounds grows with the logarithm of the component size, not with its diameter. Nothing is collected but one
row of counts for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table (a bigint, b bigint); root is the smallest node reachable."""
    tidy = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    now = cut(tidy(edges))
    known = state(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = tidy(both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(tidy(small.union(least.select("u", "m"))))
        found = state(now)
        if found == known:
            break
        known = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
