"""Clustering of features by method name, with the rules for small channels and for the number of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import EVENTS_PER_CLUSTER, MAX_CLUSTERS, MIN_CLUSTERS, cluster_count
from ..functions.vectors import sum_by_position
from ..plans.spread import Spread, materialize, number_rows, spread
from ..session import KEYS
from .kmeans import kmeans
from .mixture import gaussian_mixture

METHODS = ("km", "mlkm", "sklkm", "gmm", "sklgmm")


def bypass_small(points: Spread, limit: int = MIN_CLUSTERS) -> DataFrame:
    """Groups of at most ``limit`` events: each event is its own cluster."""
    small = points.attach(points.sizes.filter(F.col("n") <= limit).select(*points.keys))
    order = W.partitionBy(*points.keys).orderBy("event_id")
    return small.withColumn("cluster", F.row_number().over(order) - 1).select(*points.keys, "event_id", "x", "cluster")


def _clusters_at_most(largest: int) -> int:
    return min(MAX_CLUSTERS, max(MIN_CLUSTERS, -(-largest // EVENTS_PER_CLUSTER)))


def cluster_events(
    features: DataFrame, method: str = "km", width: int = 10, k: int | None = None, seed: int = 1, **options
) -> DataFrame:
    """``keys…, event_id, x, cluster``.

    ``km`` and ``gmm`` work per channel interval; ``mlkm`` (also ``sklkm``) and ``sklgmm`` per interval, over its
    channels together. All groups are in the same jobs. Without ``k`` the number of clusters follows the event count
    of the group.
    """
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unsupported clustering {method!r}")
    points = spread(features.select(*KEYS, "event_id", "x"), KEYS)
    columns = [*KEYS, "event_id", "x", "cluster"]
    if method in ("mlkm", "sklkm", "sklgmm"):
        largest = points.sizes.groupBy(*KEYS[:2]).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        fit = gaussian_mixture if method == "sklgmm" else kmeans
        rule = F.lit(k) if k else cluster_count(F.col("n"))
        placed, _ = fit(points, rule, k or _clusters_at_most(largest), width, seed=seed, pool=KEYS[:2], **options)
        return placed.select(columns)

    rest_sizes = points.sizes.filter(F.col("n") > MIN_CLUSTERS)
    k_rule: Column = F.lit(k) if k else cluster_count(F.col("n"))
    k_max = k or _clusters_at_most(points.largest)
    rest = points.with_points(points.attach(rest_sizes.select(*KEYS)))
    if method == "km":
        placed, _ = kmeans(rest, k_rule, k_max, width, seed=seed, **options)
    else:
        placed, _ = gaussian_mixture(rest, k_rule, k_max, width, seed=seed, **options)
    return placed.select(columns).unionByName(bypass_small(points).select(columns))


def cluster_summary(assigned: DataFrame, width: int) -> DataFrame:
    """``recording, interval_id, channel, cluster, ord, n, sum, s_chn, e_chn``; ``ord`` runs by channel, cluster.

    Count and vector sum are all that the merge distance needs, so no member list is kept.
    """
    summary = assigned.groupBy(*KEYS, "cluster").agg(
        F.count(F.lit(1)).alias("n"),
        sum_by_position("x", width).alias("sum"),
        F.min("channel").alias("s_chn"),
        F.max("channel").alias("e_chn"),
    )
    return number_rows(materialize(summary), KEYS[:2], ["channel", "cluster"], "ord")


def cluster_members(assigned: DataFrame, piece: int = 100_000) -> DataFrame:
    """Member ids per cluster, for export: lists in pieces of about ``piece`` ids, so no cluster is one huge row."""
    points = spread(assigned.select(*KEYS, "cluster", "event_id"), [*KEYS, "cluster"], piece).points
    lists = points.groupBy(*KEYS, "cluster", "salt").agg(F.array_sort(F.collect_list("event_id")).alias("members"))
    return lists.withColumnRenamed("salt", "piece")
