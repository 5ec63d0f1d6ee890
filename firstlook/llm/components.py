"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from firstlook.plans.written import written


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id of links (a, b), the smallest id that it is connected with.

    Each round hangs nodes on the smallest neighbour they know of, so the number of rounds grows with the logarithm of the longest path.
    Minima are taken before the shuffle and joined back, so a node with very many links is spread like any other. Every round is written,
    which cuts the lineage.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = written(small.filter("u <> v").distinct())
        same = [t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for t in (edges, after)]
        edges = after
        if same[0] == same[1]:
            roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
