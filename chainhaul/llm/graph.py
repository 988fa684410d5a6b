"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every end of a link (a, b), the least id it reaches.

    Large and small stars in turn (each vertex hands its neighbours to the least
    of them) until nothing changes: rounds grow with the logarithm of the
    longest path.  Hot vertices cost one row a neighbour; least neighbours are
    pre-aggregated, and joins on a hot vertex can be split.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        after = _mark(edges)
        if after == before:
            break
        before = after
    least = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return least.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
