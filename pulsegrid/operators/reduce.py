"""Feature extraction: PCA per channel, PCA pooled over channels, and the library's PCA."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.chunked import per_group, per_point
from ..plans.spread import ROWS_PER_CHUNK, spread
from ..session import KEYS
from .kmeans import one_interval
from .moments import covariance, from_upper, points_of, upper

# Fixed value of the workload.
COMPONENTS = 10


def basis_bytes(k: int, width: int) -> int:
    return 64 + 8 * (k + 1) * width


def _leading_vectors(cov: np.ndarray, k: int) -> np.ndarray:
    values, vectors = np.linalg.eigh(np.nan_to_num(from_upper(cov)))
    leading = vectors[:, np.argsort(values)[::-1][:k]].T
    largest = np.abs(leading).argmax(axis=1)
    return leading * np.where(leading[np.arange(len(leading)), largest] < 0, -1.0, 1.0)[:, None]


def pca_basis(covariances: DataFrame, keys: list[str], k: int = COMPONENTS) -> DataFrame:
    """``keys…, mean, basis``: the k leading eigenvectors, by rows.

    Sorted by eigenvalue, largest first; the sign is fixed so that the component of largest magnitude is positive.
    Values that are not finite count as zero (infinities as the largest number).
    """

    def decompose(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"mean": cells["mean"], "basis": _leading_vectors(cells["cov"], k)}

    return per_group(covariances, keys, ["mean", "cov"], ["mean", "basis"], decompose)


def pca_features(
    waves: DataFrame,
    k: int = COMPONENTS,
    basis: str = "channel",
    column: str = "wave",
    rows_per_chunk: int = ROWS_PER_CHUNK,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``keys…, event_id, x``: centred waveforms projected on their leading components.

    ``basis='channel'`` fits one basis per channel interval, so coordinates of different channels are not in the
    same frame; ``basis='pooled'`` fits one for all channels of an interval and makes their distances comparable.
    ``carry`` names further columns to return; rows that differ in them are kept in separate chunks. With a basis per
    channel and nothing carried, a group that is one chunk row gets its basis in the task that projects it.
    """
    if basis not in ("channel", "pooled"):
        raise ValueError(f"unsupported basis {basis!r}")
    keys = [*KEYS, *carry]
    points = waves.select(*keys, "event_id", F.col(column).alias("x"))
    shape = points.select(F.size("x")).head(1)
    row_bytes = basis_bytes(k, shape[0][0] if shape else 0)
    chunks = spread(points, keys).chunks(["x"], row_bytes, rows_per_chunk)
    if basis == "pooled" or carry:
        chunks = chunks.pooled(KEYS[:2] if basis == "pooled" else KEYS)
    chunks = chunks.settle()
    output = T.StructField("x", T.ArrayType(T.DoubleType()))
    done = None
    if basis == "channel" and not carry:

        def fit_and_project(cells: dict[str, np.ndarray]) -> list[np.ndarray]:
            x = points_of(cells)
            away = x - x.sum(axis=0) / len(x)
            return [away @ _leading_vectors(upper(away.T @ away) / len(x), k).T]

        small, rest = chunks.by_rows(rows_per_chunk)
        done = per_point(small.points, keys, ["x"], [output], fit_and_project).select(*keys, "event_id", "x")
        if rest is None:
            return done
        chunks = rest
    bases = chunks.hold(pca_basis(covariance(chunks, 64 + 8 * (shape[0][0] if shape else 0)), chunks.keys, k), row_bytes)
    ready = chunks.attach(bases, row_bytes)

    def project(cells: dict[str, np.ndarray]) -> list[np.ndarray]:
        away = points_of(cells) - cells["mean"]
        return [away @ cells["basis"].reshape(-1, away.shape[1]).T]

    large = per_point(ready, keys, ["x", "mean", "basis"], [output], project).select(*keys, "event_id", "x")
    return large if done is None else done.unionByName(large)


def library_pca(waves: DataFrame, k: int = COMPONENTS, column: str = "wave") -> DataFrame:
    """One library PCA over all rows, for a table of one interval. Not centred: it differs from ours by a shift."""
    one_interval(waves)
    vectors = waves.select(*KEYS, "event_id", array_to_vector(column).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(vectors)
    return model.transform(vectors).select(*KEYS, "event_id", vector_to_array("_pc").alias("x"))


def extract_features(waves: DataFrame, method: str = "pca", k: int = COMPONENTS, **options) -> DataFrame:
    """Features by method name: ``pca`` or ``mlpca`` (one basis for all channels of an interval), in any case."""
    match method.lower():
        case "pca":
            return pca_features(waves, k, **options)
        case "mlpca":
            return pca_features(waves, k, basis="pooled", **options)
    raise ValueError(f"unsupported feature extraction {method!r}")
