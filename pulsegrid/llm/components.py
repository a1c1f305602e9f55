"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, give_back, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``v`` and ``root``, the smallest vertex reachable from it, for every vertex of ``edges`` (``a``, ``b``; longs).

    Alternates two steps until nothing changes: every vertex links its larger neighbours to the smallest vertex next to
    it, then links its smaller neighbours and itself to the smallest of them. Each step keeps the components, the edges
    do not grow, and the number of rounds is logarithmic. Minima are combined before they are shuffled. Both sides of
    the joins are written tables, so that adaptive execution splits a vertex with very many neighbours. Each round is
    written, so a lost executor costs one round at most.
    """
    links = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = materialize(links.distinct())
    count, before = links.count(), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m"))
        least = materialize(fitted(least.withColumn("_m", F.least("_m", "u")), count))
        large = both.join(least.hint("shuffle_merge"), "u").filter(F.col("v") > F.col("u"))
        large = materialize(fitted(large.select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct(), count))
        least = materialize(fitted(large.groupBy("u").agg(F.min("v").alias("_m")), count))
        small = large.join(least.hint("shuffle_merge"), "u").filter(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        links = materialize(fitted(small.unionByName(least.select("u", F.col("_m").alias("v"))).distinct(), count))
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        count, before = state[0], state
        give_back(edges.sparkSession)
    roots = links.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return roots.unionByName(roots.select("root").distinct().select(F.col("root").alias("v"), "root"))
