"""k-means over many groups at once: every round is one job for all channels together.

Distances are matrix products on chunk rows; sums per cluster add up over chunks. ``centers`` is one flat array per
group, k times the width.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import uniform, uniforms
from ..plans.chunked import add_up, best_point, chosen_points, leading_point, per_group, per_point
from ..plans.spread import Spread
from ..session import KEYS
from .moments import points_of

VECTOR = T.ArrayType(T.DoubleType())

# Fixed value of the workload: assignments are made max_iter + 1 times.
MAX_ITER = 20


def center_bytes(k: int, width: int) -> int:
    return 64 + 8 * k * width


def random_seeds(points: Spread, k: Column, k_max: int, seed: int = 1) -> DataFrame:
    """``keys…, centers``: per group the k points with the smallest draws, so none is taken twice.

    The constant bound ``k_max`` lets Spark keep only the leading rows of each group before the shuffle. In groups of
    several channels, draws depend on the channel too.
    """
    ids = ["event_id", *[c for c in KEYS if c not in points.keys and c in points.points.columns]]
    order = W.partitionBy(*points.keys).orderBy("_u", *ids)
    drawn = points.points.withColumn("_u", uniform(seed, 0, *[F.col(c) for c in ids]))
    best = (
        drawn.select(*points.keys, *ids, "x", "_u", F.row_number().over(order).alias("_rank"))
        .filter(F.col("_rank") <= k_max)
        .join(points.sizes, points.keys)
        .filter(F.col("_rank") <= k)
    )
    picked = F.array_sort(F.collect_list(F.struct("_rank", "x")))
    return best.groupBy(*points.keys).agg(F.flatten(picked["x"]).alias("centers"))


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Points by centres, as sums of squared differences (no cancellation)."""
    out = np.empty((len(x), len(centers)))
    for c, center in enumerate(centers):
        away = x - center
        out[:, c] = np.einsum("ij,ij->i", away, away)
    return out


def _centers_of(cells: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return cells["centers"].reshape(-1, x.shape[1])


def _race_times(cells: dict[str, np.ndarray], centers: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Exponential times with the squared distance to the nearest of ``centers`` as their rate."""
    away = squared_distances(points_of(cells), centers).min(axis=1)
    draws = -np.log(uniforms(seed, step, cells["event_ids"]))
    return np.divide(draws, away, out=np.full(len(away), np.inf), where=away > 0)


def spread_out_seeds(points: Spread, chunks: Spread, k: Column, k_max: int, row_bytes: int, seed: int = 1) -> DataFrame:
    """k-means++ seeds, ``keys…, centers``: each next seed is drawn with probability ∝ squared distance.

    The draw is a race: among exponential times with rate d², the smallest belongs to a point with probability
    ∝ d². So one minimum per group and round replaces a running sum, and the result does not depend on how rows
    are partitioned. Points that equal a seed never win; identical points give fewer seeds.

    ``chunks`` are settled chunk rows of ``points``. The race is run inside them, and a task hands on one point per
    group. Distances to all seeds so far are worked out anew each round: for the ten seeds there are at most, that is
    cheaper than to write and to join a distance for every point.
    """
    keys = points.keys
    first = best_point(chunks.points, keys, [], lambda cells: uniforms(seed, 0, cells["event_ids"])).select(*keys, F.col("x").alias("centers"))
    seeds = points.hold(first.join(points.sizes, keys).select(*keys, k.alias("_k"), "centers"), row_bytes)

    def race(step: int):
        return lambda cells: _race_times(cells, _centers_of(cells, points_of(cells)), seed, step)

    for step in range(1, k_max):
        wanting = seeds.filter(F.col("_k") > step).select(*keys, "centers")
        won = best_point(chunks.attach(wanting, row_bytes), keys, ["centers"], race(step)).select(*keys, F.col("x").alias("_x"))
        grown = F.when(F.col("_x").isNull(), F.col("centers")).otherwise(F.concat("centers", "_x"))
        seeds = points.hold(seeds.join(won, keys, "left").select(*keys, "_k", grown.alias("centers")), row_bytes)
    return seeds.drop("_k")


def parallel_seeds(chunks: Spread, k: Column, k_max: int, width: int, seed: int = 1, rounds: int = 2, factor: int = 2) -> DataFrame:
    """k-means‖ seeds, ``keys…, centers``, of groups of any size: a few rounds of oversampling, then a weighted race.

    A round keeps every point with probability ``factor`` · k · d² / Σ d², with d the distance to the nearest candidate
    so far, so about ``factor`` · k candidates join per round. Each candidate then weighs as many points as it is the
    nearest of, and k-means++ draws the seeds among the weighted candidates of a group. Draws depend on ids alone; in
    groups of several channels, on the channel too. ``chunks`` are settled.
    """
    keys = chunks.keys
    other = [c for c in KEYS if c not in keys and c in chunks.points.columns]
    rows = chunks.with_points(chunks.points.withColumn("_other", F.array(*[F.col(c).cast("bigint") for c in other]).cast("array<bigint>")))
    wanted = chunks.sizes.select(*keys, F.array(k.cast("double")).alias("k"))
    # Candidates are a sum of independent draws: three times their mean has never to be exceeded for them to fit.
    row_bytes = center_bytes(1 + 3 * rounds * factor * k_max, width)
    used = ["event_ids", "x", "_other", "centers"]

    def draws(cells: dict[str, np.ndarray], step: int) -> np.ndarray:
        return uniforms(seed, step, cells["event_ids"], *cells["_other"])

    def gaps(cells: dict[str, np.ndarray]) -> np.ndarray:
        x = points_of(cells)
        return squared_distances(x, _centers_of(cells, x))

    first = best_point(rows.points, keys, ["_other"], lambda cells: draws(cells, 0))
    known = chunks.hold(first.select(*keys, F.col("x").alias("centers")), row_bytes)
    for step in range(1, rounds + 1):

        def keep(cells: dict[str, np.ndarray], step: int = step) -> np.ndarray:
            away = gaps(cells).min(axis=1)
            chance = np.divide(factor * cells["k"][0] * away, cells["stats"][0], out=np.zeros(len(away)), where=away > 0)
            return draws(cells, step) < chance

        spread_of = chunks.hold(add_up(rows.attach(known, row_bytes), keys, used, lambda cells: gaps(cells).min(axis=1).sum(keepdims=True)), 64)
        params = known.join(spread_of, keys).join(wanted, keys)
        found = chosen_points(rows.attach(params, row_bytes), [*keys, *other], [*used, "stats", "k"], keep)
        listed = F.array_sort(F.collect_list(F.struct("event_id", *other, "x")))
        found = found.groupBy(*keys).agg(F.flatten(F.transform(listed, lambda p: p["x"])).alias("_new"))
        grown = F.concat("centers", F.coalesce("_new", F.array().cast("array<double>")))
        known = chunks.hold(known.join(found, keys, "left").select(*keys, grown.alias("centers")), row_bytes)

    def weights(cells: dict[str, np.ndarray]) -> np.ndarray:
        away = gaps(cells)
        return np.bincount(away.argmin(axis=1), minlength=away.shape[1]).astype(np.float64)

    def race(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        weight = cells["stats"]
        points, at, near = cells["centers"].reshape(len(weight), -1), [], np.ones(len(weight))
        for step in range(int(cells["k"][0])):
            rate = weight * near
            if not (rate > 0).any():
                break
            times = np.divide(-np.log(uniforms(seed, 100 + step, range(len(weight)))), rate, out=np.full(len(rate), np.inf), where=rate > 0)
            at.append(int(times.argmin()))
            near = squared_distances(points, points[at]).min(axis=1)
        return {"seeds": points[at]}

    heavy = add_up(rows.attach(known, row_bytes), keys, used, weights).join(known, keys).join(wanted, keys)
    seeds = per_group(heavy, keys, ["stats", "centers", "k"], ["seeds"], race)
    return chunks.hold(seeds.withColumnRenamed("seeds", "centers"), center_bytes(k_max, width))


def assign_nearest(chunks: Spread, centers: DataFrame, row_bytes: int, keys: list[str] | None = None) -> DataFrame:
    """``keys…, event_id, x, cluster, d2``: the nearest centre of each point, the first on ties.

    ``keys`` are columns of the chunk rows to return instead of the groups' keys.
    """

    def nearest(cells: dict[str, np.ndarray]) -> list[np.ndarray]:
        x = points_of(cells)
        gaps = squared_distances(x, _centers_of(cells, x))
        best = gaps.argmin(axis=1)
        return [x, best.astype(np.int32), gaps[np.arange(len(x)), best]]

    fields = [T.StructField("x", VECTOR), T.StructField("cluster", T.IntegerType()), T.StructField("d2", T.DoubleType())]
    return per_point(chunks.attach(centers, row_bytes), keys or chunks.keys, ["x", "centers"], fields, nearest)


def _member_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per centre of ``at``: how many points are nearest to it, and their sum."""
    member = np.eye(len(at))[squared_distances(x, at).argmin(axis=1)]
    return np.concatenate([member.sum(axis=0)[:, None], member.T @ x], axis=1)


def _renewed(parts: np.ndarray, old: np.ndarray) -> np.ndarray:
    counts = np.rint(parts[:, :1])
    return np.where(counts > 0, parts[:, 1:] / np.maximum(counts, 1), old)


def move_centers(chunks: Spread, centers: DataFrame, row_bytes: int) -> DataFrame:
    """One round: the mean of each cluster's points; an empty cluster keeps its centre. Adds ``moved`` (0 or 1)."""

    def sums_of(cells: dict[str, np.ndarray]) -> np.ndarray:
        x = points_of(cells)
        return _member_sums(x, _centers_of(cells, x)).reshape(-1)

    sums = add_up(chunks.attach(centers.select(*chunks.keys, "centers"), row_bytes), chunks.keys, ["event_ids", "x", "centers"], sums_of)

    def renew(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        k = len(cells["stats"]) - len(cells["centers"])
        old = cells["centers"].reshape(k, -1)
        new = _renewed(cells["stats"].reshape(k, -1), old)
        return {"centers": new, "moved": np.array([float((new != old).any())])}

    joined = sums.join(centers.select(*chunks.keys, "centers"), chunks.keys)
    return per_group(joined, chunks.keys, ["stats", "centers"], ["centers", "moved"], renew)


def lloyd(chunks: Spread, centers: DataFrame, row_bytes: int, max_iter: int = MAX_ITER) -> DataFrame:
    """Centres after ``max_iter`` rounds. Rounds stop early once no centre moves, which gives the same result."""
    for _ in range(max_iter):
        centers = chunks.hold(move_centers(chunks, centers, row_bytes), row_bytes)
        if centers.filter("moved[0] > 0").isEmpty():
            break
    return centers.select(*chunks.keys, "centers")


def centers_of_small(chunks: Spread, k: Column, k_max: int, max_iter: int, seed: int) -> DataFrame:
    """Seeds and all rounds of groups that are one chunk row each, in one pass; ``keys…, centers``.

    Draws and sums are those of ``spread_out_seeds`` and ``lloyd``, so the centres are the same.
    """
    wanted = chunks.sizes.select(*chunks.keys, F.array(k.cast("double")).alias("k"))

    def settle(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, ids = points_of(cells), cells["event_ids"]
        at = [leading_point(uniforms(seed, 0, ids), ids)]
        for step in range(1, min(int(cells["k"][0]), k_max)):
            won = leading_point(_race_times(cells, x[at], seed, step), ids)
            if won is None:
                break
            at.append(won)
        centers = x[at]
        for _ in range(max_iter):
            old, centers = centers, _renewed(_member_sums(x, centers), centers)
            if not (centers != old).any():
                break
        return {"centers": centers}

    return per_group(chunks.attach(wanted), chunks.keys, ["event_ids", "x", "k"], ["centers"], settle)


def kmeans(
    points: Spread,
    k: Column,
    k_max: int,
    width: int,
    max_iter: int = MAX_ITER,
    init: str = "kpp",
    seed: int = 1,
    centers: DataFrame | None = None,
    pool: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``keys…, event_id, x, cluster, d2``, and the centres that the points were assigned to.

    The last assignment is made before a further update, so the centres returned are those of the assignment.
    ``init``: ``kpp``, ``parallel`` or ``random``; given ``centers`` replace it. ``pool`` names a part of the keys: all
    groups that agree in it are then clustered together, from seeds by ``parallel`` unless ``random`` is asked for.

    With ``kpp``, a group that is one chunk row goes through seeds and rounds in the task that reads it. Larger ones go
    through a job a round, in which no group is gathered.
    """
    row_bytes = center_bytes(k_max, width)
    chunks, whole = points.chunks(["x"], row_bytes), points
    if pool:
        chunks, whole = chunks.pooled(pool), points.pooled(pool)
        init = "random" if init == "random" else "parallel"
    chunks, done = chunks.settle(), None
    rest = chunks
    if centers is None and init == "kpp":
        small, rest = chunks.by_rows()
        done = chunks.hold(centers_of_small(small, k, k_max, max_iter, seed), row_bytes)
        if rest is None:
            return assign_nearest(chunks, done, row_bytes, points.keys), done
    if centers is None:
        if init == "kpp":
            centers = spread_out_seeds(points, rest, k, k_max, row_bytes, seed)
        elif init == "parallel":
            centers = parallel_seeds(chunks, k, k_max, width, seed)
        elif init == "random":
            centers = chunks.hold(random_seeds(whole, k, k_max, seed), row_bytes)
        else:
            raise ValueError(f"unsupported init {init!r}")
    centers = lloyd(rest, centers, row_bytes, max_iter)
    if done is not None:
        centers = done.unionByName(centers)
    return assign_nearest(chunks, centers, row_bytes, points.keys), centers


def cluster_error(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Within-cluster sum of squared distances and member count, per cluster."""
    return assigned.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("wsse"))


def one_interval(table: DataFrame) -> None:
    """Refuse a table of several intervals: one library model would mix them."""
    scope = [c for c in KEYS[:2] if c in table.columns]
    if scope and len(table.select(*scope).distinct().head(2)) > 1:
        raise ValueError("a library model fits one interval; this table has several")
