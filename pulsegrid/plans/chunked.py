"""Numpy work on chunk rows: additive statistics per group, and maps from a chunk back to its points.

A chunk row is a bounded piece of a group (``Spread.chunks``), so tasks see pieces only. Additive statistics are
summed inside each task first; what is shuffled is one vector per (task, group), and Spark's vector aggregate adds
those with its own partial aggregation.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import sum_vectors

HELD_GROUPS = 256  # groups whose sums a task holds before it emits them


def _cells(batch: pa.RecordBatch, columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Per row of ``batch``: its array columns as numpy arrays."""
    lists = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
    flats = {c: (v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)) for c, v in lists.items()}
    for i in range(batch.num_rows):
        yield {c: flat[at[i] : at[i + 1]] for c, (at, flat) in flats.items()}


def _list_column(vectors: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int32)
    values = np.concatenate(vectors) if vectors else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.float64)))


def add_up(
    chunks: DataFrame, keys: list[str], columns: list[str], statistic: Callable[[dict[str, np.ndarray]], np.ndarray]
) -> DataFrame:
    """``keys…, stats``: the element-wise sum of ``statistic`` over the chunks of each group."""
    key_fields = [chunks.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def emit(sums: dict[tuple, np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
        heads = [pa.array([k[i] for k in sums], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*heads, _list_column(list(sums.values()))], names=[*keys, "stats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            labels = zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys])
            for key, cells in zip(labels, _cells(batch, columns)):
                value = statistic(cells)
                sums[key] = sums[key] + value if key in sums else value
                if len(sums) > HELD_GROUPS:
                    yield emit(sums, types)
                    sums = {}
        if sums:
            yield emit(sums, types)

    partial = chunks.select(*keys, *columns).mapInArrow(run, schema)
    return partial.groupBy(*keys).agg(sum_vectors(partial["stats"]).alias("stats"))


def _narrow(values: np.ndarray) -> tuple[np.ndarray, np.dtype]:
    if values.dtype == np.float64:
        with np.errstate(over="ignore"):
            half = values.astype(np.float32)
        if np.array_equal(half.astype(np.float64), values, equal_nan=True):
            return half, values.dtype
    return values, values.dtype


def unpacked(cells: bytes) -> dict[str, np.ndarray]:
    return {c: v.astype(dtype, copy=False) for c, (v, dtype) in pickle.loads(cells).items()}


def packed_cells(chunks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys…, cells``: the array columns of each chunk as one value, for points that are read over and over.

    Numbers that are exact in half the bytes are kept in them; ``unpacked`` gives them back as they were.
    """
    schema = T.StructType([*[chunks.schema[k] for k in keys], T.StructField("cells", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            made = [pickle.dumps({c: _narrow(v) for c, v in cells.items()}, pickle.HIGHEST_PROTOCOL) for cells in _cells(batch, columns)]
            yield pa.RecordBatch.from_arrays([*heads, pa.array(made, pa.binary())], names=[*keys, "cells"])

    return chunks.select(*keys, *columns).mapInArrow(run, schema)


def add_up_packed(
    packed: RDD, params: dict[tuple, dict[str, np.ndarray]], statistic: Callable[[dict[str, np.ndarray]], np.ndarray]
) -> dict[tuple, np.ndarray]:
    """As ``add_up``, in one stage over rows of ``packed_cells``; a chunk meets its group's ``params``, if there are any."""

    def run(rows: Iterator[tuple]) -> Iterator[dict[tuple, np.ndarray]]:
        sums: dict[tuple, np.ndarray] = {}
        for *key, cells in rows:
            key = tuple(key)
            if key in params:
                value = statistic(unpacked(cells) | params[key])
                sums[key] = sums[key] + value if key in sums else value
        yield sums

    total: dict[tuple, np.ndarray] = {}
    for sums in packed.mapPartitions(run).collect():
        for key, value in sums.items():
            total[key] = total[key] + value if key in total else value
    return total


def per_group(
    rows: DataFrame,
    keys: list[str],
    columns: list[str],
    outputs: list[str],
    work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]],
) -> DataFrame:
    """``keys…, outputs…``: numpy work on one row per group, such as an eigen-decomposition."""
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(o, T.ArrayType(T.DoubleType())) for o in outputs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [work(cells) for cells in _cells(batch, columns)]
            heads = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            made = [_list_column([np.ravel(d[o]) for d in done]) for o in outputs]
            yield pa.RecordBatch.from_arrays([*heads, *made], names=[*keys, *outputs])

    return rows.select(*keys, *columns).mapInArrow(run, schema)


def per_point(
    chunks: DataFrame,
    keys: list[str],
    columns: list[str],
    outputs: list[T.StructField],
    work: Callable[[dict[str, np.ndarray]], list[np.ndarray]],
) -> DataFrame:
    """``keys…, event_id, outputs…``: one row per point; ``work`` gives one array, or matrix, per output."""
    schema = T.StructType([*[chunks.schema[k] for k in keys], T.StructField("event_id", T.LongType()), *outputs])
    columns = ["event_ids", *[c for c in columns if c != "event_ids"]]

    def column_of(values: np.ndarray) -> pa.Array:
        if values.ndim == 1:
            return pa.array(values)
        offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, cells in enumerate(_cells(batch, columns)):
                rows = len(cells["event_ids"])
                at = pa.array(np.full(rows, i))
                heads = [batch.column(batch.schema.get_field_index(k)).take(at) for k in keys]
                made = [column_of(v) for v in work(cells)]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(cells["event_ids"]), *made], names=schema.names)

    return chunks.select(*keys, *columns).mapInArrow(run, schema)


def chosen_points(chunks: DataFrame, keys: list[str], columns: list[str], choose: Callable[[dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    """``keys…, event_id, x`` of the points for which ``choose`` is true; no other point leaves its task."""
    schema = T.StructType([*[chunks.schema[k] for k in keys], T.StructField("event_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    columns = list(dict.fromkeys(["event_ids", "x", *columns]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, points = [], [], []
            for i, cells in enumerate(_cells(batch, columns)):
                at = np.flatnonzero(choose(cells))
                rows += [i] * len(at)
                ids += cells["event_ids"][at].tolist()
                points += list(cells["x"].reshape(len(cells["event_ids"]), -1)[at])
            heads = [batch.column(batch.schema.get_field_index(k)).take(pa.array(rows, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*heads, pa.array(ids, pa.int64()), _list_column(points)], names=schema.names)

    return chunks.select(*dict.fromkeys([*keys, *columns])).mapInArrow(run, schema)


def leading_point(scores: np.ndarray, ids: np.ndarray) -> int | None:
    """Place of the smallest score, the smallest id on ties; None if no score is finite."""
    if not np.isfinite(scores).any():
        return None
    return int(min(np.flatnonzero(scores == np.nanmin(scores)), key=lambda i: ids[i]))


def best_point(chunks: DataFrame, keys: list[str], columns: list[str], score: Callable[[dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    """``keys…, event_id, score, x``: the point of smallest finite ``score`` in each group, the smallest id on ties.

    A task hands on its best point of each group only, so what is shuffled does not depend on the number of points.
    """
    fields = [("event_id", T.LongType()), ("score", T.DoubleType()), ("x", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*[chunks.schema[k] for k in keys], *[T.StructField(*f) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple] = {}
        types: list[pa.DataType] = []

        def emit() -> pa.RecordBatch:
            heads = [pa.array([k[i] for k in best], t) for i, t in enumerate(types)]
            scores, ids, points = zip(*best.values())
            return pa.RecordBatch.from_arrays([*heads, pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), _list_column(list(points))], names=schema.names)

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            labels = zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys])
            for key, cells in zip(labels, _cells(batch, list(dict.fromkeys(["event_ids", "x", *columns])))):
                scores, ids = score(cells), cells["event_ids"]
                at = leading_point(scores, ids)
                if at is None:
                    continue
                if key not in best or (scores[at], ids[at]) < best[key][:2]:
                    best[key] = float(scores[at]), int(ids[at]), cells["x"].reshape(len(ids), -1)[at].copy()
                if len(best) > HELD_GROUPS:
                    yield emit()
                    best.clear()
        if best:
            yield emit()

    found = chunks.select(*keys, *dict.fromkeys(["event_ids", "x", *columns])).mapInArrow(run, schema)
    first = F.min(F.struct("score", "event_id", "x")).alias("_b")
    return found.groupBy(*keys).agg(first).select(*keys, "_b.event_id", "_b.score", "_b.x")
