"""Means and population covariances per group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.chunked import add_up
from ..plans.spread import Spread


def points_of(cells: dict[str, np.ndarray], column: str = "x") -> np.ndarray:
    """The chunk's points as a matrix, one row per point."""
    return cells[column].reshape(len(cells["event_ids"]), -1)


def upper(matrix: np.ndarray) -> np.ndarray:
    return matrix[np.triu_indices(len(matrix))]


def from_upper(flat: np.ndarray) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    size = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    matrix = np.zeros((size, size))
    matrix[np.triu_indices(size)] = flat
    return matrix + np.triu(matrix, 1).T


def group_means(chunks: Spread) -> DataFrame:
    """``keys…, n, mean`` from chunk rows with ``x``."""
    sums = add_up(chunks.points, chunks.keys, ["event_ids", "x"], lambda cells: points_of(cells).sum(axis=0))
    return sums.join(chunks.sizes.select(*chunks.keys, "n"), chunks.keys).select(
        *chunks.keys, "n", F.transform("stats", lambda v: v / F.col("n")).alias("mean")
    )


def group_covariances(chunks: Spread, means: DataFrame, row_bytes: int) -> DataFrame:
    """``keys…, n, mean, cov``: population covariance around the group mean, as an upper triangle by rows."""
    centred = chunks.attach(means.select(*chunks.keys, "mean"), row_bytes)

    def statistic(cells: dict[str, np.ndarray]) -> np.ndarray:
        away = points_of(cells) - cells["mean"]
        return upper(away.T @ away)

    sums = add_up(centred, chunks.keys, ["event_ids", "x", "mean"], statistic)
    return sums.join(means, chunks.keys).select(
        *chunks.keys, "n", "mean", F.transform("stats", lambda v: v / F.col("n")).alias("cov")
    )


def covariance(chunks: Spread, row_bytes: int = 1024) -> DataFrame:
    """Mean pass, then the centred second-moment pass."""
    means = chunks.hold(group_means(chunks), row_bytes)
    return group_covariances(chunks, means, row_bytes)
