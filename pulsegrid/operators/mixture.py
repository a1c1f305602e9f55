"""Gaussian mixtures over many groups at once: expectation-maximisation as additive statistics of chunk rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.chunked import add_up, per_group, per_point
from ..plans.spread import Spread
from .kmeans import random_seeds
from .moments import covariance, from_upper, points_of, upper

# Fixed values of the workload: max_iter + 1 rounds, and the ridge on every covariance.
MAX_ITER = 20
RIDGE = 1e-6

PARAMETERS = ["weights", "means", "covs"]


def parameter_bytes(k: int, width: int) -> int:
    return 64 + 8 * k * (1 + width + width * width)


def unpack(cells: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    weights = cells["weights"]
    means = cells["means"].reshape(len(weights), -1)
    return weights, means, cells["covs"].reshape(len(weights), means.shape[1], means.shape[1])


def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Log of the normal density, points by components. A singular covariance uses its positive part only."""
    out = np.empty((len(x), len(means)))
    for i, (mean, cov) in enumerate(zip(means, covs)):
        values, vectors = np.linalg.eigh(cov)
        real = values > 1e6 * np.finfo(float).eps * np.abs(values).max()
        white = (x - mean) @ (vectors[:, real] / np.sqrt(values[real]))
        out[:, i] = -0.5 * ((white**2).sum(axis=1) + np.log(values[real]).sum() + real.sum() * np.log(2 * np.pi))
    return out


def responsibilities_of(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Share of each component in each point, computed in logs so that far points do not become 0/0."""
    with np.errstate(divide="ignore"):
        scores = log_density(x, means, covs) + np.log(weights)
    scores -= scores.max(axis=1, keepdims=True)
    share = np.exp(scores)
    return share / share.sum(axis=1, keepdims=True)


def ridged(covs: np.ndarray) -> np.ndarray:
    return covs + RIDGE * np.eye(covs.shape[1])


def responsibilities(chunks: Spread, parameters: DataFrame, row_bytes: int) -> DataFrame:
    """Expectation step: ``keys…, event_id, shares`` with one share per component."""

    def shares(cells: dict[str, np.ndarray]) -> list[np.ndarray]:
        weights, means, covs = unpack(cells)
        return [responsibilities_of(points_of(cells), weights, means, ridged(covs))]

    output = T.StructField("shares", T.ArrayType(T.DoubleType()))
    return per_point(chunks.attach(parameters, row_bytes), chunks.keys, ["x", *PARAMETERS], [output], shares)


def start(chunks: Spread, seeds: DataFrame, row_bytes: int) -> DataFrame:
    """Equal weights, the seeds as means, and the group's sample variances on the diagonal."""
    base = covariance(chunks).join(seeds.select(*chunks.keys, F.col("centers").alias("seeds")), chunks.keys)
    counted = base.withColumn("count", F.array(F.col("n").cast("double")))

    def lay_out(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n, width = cells["count"][0], len(cells["mean"])
        k = len(cells["seeds"]) // width
        spread_of = np.diag(from_upper(cells["cov"])) * n / max(n - 1, 1)
        covs = np.repeat(ridged(np.diag(spread_of)[None]), k, axis=0)
        return {"weights": np.full(k, 1 / k), "means": cells["seeds"], "covs": covs}

    return per_group(counted, chunks.keys, ["mean", "cov", "seeds", "count"], PARAMETERS, lay_out)


def em_round(chunks: Spread, parameters: DataFrame, row_bytes: int) -> DataFrame:
    """One expectation and maximisation round for all groups.

    Per chunk: for each component the share sum, and first and second moments around its present mean; these add
    up over chunks, and the shift by the present mean keeps the second moment free of cancellation.
    """

    def moments(cells: dict[str, np.ndarray]) -> np.ndarray:
        weights, means, covs = unpack(cells)
        x = points_of(cells)
        share = responsibilities_of(x, weights, means, ridged(covs))
        parts = []
        for i in range(len(weights)):
            away = x - means[i]
            parts += [[share[:, i].sum()], share[:, i] @ away, upper((share[:, i, None] * away).T @ away)]
        return np.concatenate(parts)

    sums = add_up(chunks.attach(parameters, row_bytes), chunks.keys, ["event_ids", "x", *PARAMETERS], moments)

    def renew(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        weights, means, covs = unpack(cells)
        k, width = means.shape
        parts = cells["stats"].reshape(k, -1)
        mass = parts[:, 0]
        means, covs = means.copy(), covs.copy()
        for i in np.flatnonzero(mass > 0):
            shift = parts[i, 1 : 1 + width] / mass[i]
            means[i] += shift
            covs[i] = ridged((from_upper(parts[i, 1 + width :]) / mass[i] - np.outer(shift, shift))[None])[0]
        return {"weights": mass / mass.sum(), "means": means, "covs": covs}

    return per_group(sums.join(parameters, chunks.keys), chunks.keys, ["stats", *PARAMETERS], PARAMETERS, renew)


def label_points(
    chunks: Spread, parameters: DataFrame, row_bytes: int, weighted: bool = False, keys: list[str] | None = None
) -> DataFrame:
    """``keys…, event_id, x, cluster``: the component of highest density (times weight, if ``weighted``)."""

    def label(cells: dict[str, np.ndarray]) -> list[np.ndarray]:
        weights, means, covs = unpack(cells)
        x = points_of(cells)
        scores = log_density(x, means, covs)
        if weighted:
            with np.errstate(divide="ignore"):
                scores = scores + np.log(weights)
        return [x, scores.argmax(axis=1).astype(np.int32)]

    fields = [T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.IntegerType())]
    return per_point(chunks.attach(parameters, row_bytes), keys or chunks.keys, ["x", *PARAMETERS], fields, label)


def gaussian_mixture(
    points: Spread,
    k: Column,
    k_max: int,
    width: int,
    max_iter: int = MAX_ITER,
    seed: int = 1,
    weighted_label: bool = False,
    pool: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``keys…, event_id, x, cluster`` and the fitted parameters. Components without points simply have no rows.

    ``pool`` names a part of the keys: one mixture is then fitted to all groups that agree in it.
    """
    row_bytes = parameter_bytes(k_max, width)
    chunks, whole = points.chunks(["x"], row_bytes), points
    if pool:
        chunks, whole = chunks.pooled(pool), points.pooled(pool)
    chunks = chunks.settle()
    seeds = chunks.hold(random_seeds(whole, k, k_max, seed), row_bytes)
    parameters = chunks.hold(start(chunks, seeds, row_bytes), row_bytes)
    for _ in range(max_iter + 1):
        parameters = chunks.hold(em_round(chunks, parameters, row_bytes), row_bytes)
    return label_points(chunks, parameters, row_bytes, weighted_label, points.keys), parameters
