"""Exact medians of many groups by selection: counts of bit patterns, refined; the data are never sorted.

The first read counts, per group and column, the upper 16 bits of the values. That tells which of these bins holds the
middle. The second read keeps the different values of that bin, with their counts, and they decide. A value that all
rows share is one row with a count from its task on, so it makes no hot task. Values come from chunk rows through
numpy, so columns can be projections of points on any number of lines without one of them being written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunked import _cells, per_group
from .spread import ROWS_PER_CHUNK, Spread, fits_broadcast, materialize

BIN_BITS = 16
BINS = 1 << BIN_BITS
HELD_CELLS = 1 << 19
DISTINCT_LIMIT = 1_000_000

Matrix = Callable[[dict[str, np.ndarray]], np.ndarray]


def order_bits(values: np.ndarray) -> np.ndarray:
    """Bit patterns as integers that ascend like the values: zeros are equal, and NaN is above all."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))


def bins_of(values: np.ndarray) -> np.ndarray:
    """Column and upper bits of a matrix of values, as one number each."""
    upper = (order_bits(values) >> (64 - BIN_BITS)) + BINS // 2
    return (np.arange(values.shape[1], dtype=np.int64) << BIN_BITS) | upper


def middle(values: np.ndarray) -> np.ndarray:
    """Median of each column of a matrix, NaN counted as largest."""
    if not len(values):
        return np.full(values.shape[1], np.nan)
    ordered = np.sort(values, axis=0)
    return (ordered[(len(values) - 1) // 2] + ordered[len(values) // 2]) / 2


def _tally(rows: DataFrame, keys: list[str], columns: list[str], matrix: Matrix, valued: bool) -> DataFrame:
    """``keys…, i, bin, n``: how many values of column ``i`` fall into each bin; added up inside tasks first.

    ``valued``: instead, the different values ``v`` of the bins in ``wanted`` with their numbers.
    """
    fields = [("i", T.IntegerType()), ("bin", T.LongType()), *([("v", T.DoubleType())] if valued else []), ("n", T.LongType())]
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(*f) for f in fields]])
    used = [*columns, "wanted"] if valued else columns

    def counted(cells: np.ndarray, values: np.ndarray, n: np.ndarray):
        order = np.lexsort((values, cells)) if valued else np.argsort(cells, kind="stable")
        cells, values, n = cells[order], values[order], n[order]
        first = np.ones(len(cells), bool)
        first[1:] = cells[1:] != cells[:-1]
        if valued:
            first[1:] |= ~((values[1:] == values[:-1]) | (np.isnan(values[1:]) & np.isnan(values[:-1])))
        at = np.flatnonzero(first)
        return cells[at], values[at], np.add.reduceat(n, at) if len(at) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size, types = 0, []

        def emit():
            for key, parts in held.items():
                cells, values, n = counted(*(np.concatenate(p) for p in zip(*parts)))
                heads = [pa.array([k] * len(cells), t) for k, t in zip(key, types)]
                made = [pa.array((cells >> BIN_BITS).astype(np.int32)), pa.array((cells & (BINS - 1)) - BINS // 2)]
                made += [pa.array(values)] if valued else []
                yield pa.RecordBatch.from_arrays([*heads, *made, pa.array(n)], names=schema.names)

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            labels = zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys])
            for key, found in zip(labels, _cells(batch, used)):
                values = np.ascontiguousarray(matrix(found), dtype=np.float64)
                cells = bins_of(values).reshape(-1)
                values = values.reshape(-1) + 0.0
                if valued:
                    inside = np.isin(cells, found["wanted"])
                    cells, values = cells[inside], values[inside]
                part = counted(cells, values if valued else np.zeros(len(cells)), np.ones(len(cells), np.int64))
                held.setdefault(key, []).append(part)
                size += len(part[0])
                if size > HELD_CELLS:
                    yield from emit()
                    held, size = {}, 0
        yield from emit()

    return rows.select(*keys, *used).mapInArrow(run, schema)


def _around(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Rows of ``counts`` that hold one of the ranks ``lo`` and ``hi``, counted from ``before``; ``before`` moves on."""
    ahead = F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", F.col("before") + ahead)
    holds = lambda rank: (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("before") + F.col("n"))
    return placed.filter(holds("lo") | holds("hi"))


def _narrowed(values: DataFrame, group: list[str], limit: int) -> DataFrame:
    """``values`` until no group has more than ``limit`` different ones around its ranks.

    A group is split into 65,536 equal intervals between its ends, and those with the ranks stay. Values of one bin
    share sign, exponent and four more bits, so three rounds split them completely.
    """
    while True:
        largest = values.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        if largest <= limit:
            return values
        ends = values.groupBy(*group).agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
        split = values.join(ends, group).withColumn("_sub", F.floor((F.col("v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * (BINS - 1)))
        split = split.withColumn("_sub", F.coalesce("_sub", F.lit(0)))
        counts = split.groupBy(*group, "_sub", "before", "lo", "hi").agg(F.sum("n").alias("n"))
        kept = _around(counts, group, "_sub").select(*group, "_sub", F.col("before").alias("_before"))
        values = split.join(kept, [*group, "_sub"]).withColumn("before", F.col("_before")).withColumn("bin", F.col("bin") * BINS + F.col("_sub"))
        values = materialize(values.drop("_sub", "_before", "_low", "_high"))


def _selected(rows: DataFrame, keys: list[str], columns: list[str], matrix: Matrix, attach, limit: int) -> DataFrame:
    """``keys…, i, middle`` of ``rows``, pieces of groups of any size; ``attach(table, bytes)`` gives pieces their group's row."""
    cell = [*keys, "i"]
    bins = _tally(rows, keys, columns, matrix, False).groupBy(*cell, "bin").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy(*cell))
    ranked = bins.withColumn("_all", total).select(*cell, "bin", "n", F.lit(0).cast("bigint").alias("before"), F.floor((F.col("_all") - 1) / 2).alias("lo"), F.floor(F.col("_all") / 2).alias("hi"))
    picked = materialize(_around(ranked, cell, "bin").drop("n"))
    wanted = picked.groupBy(*keys).agg(F.collect_list(F.shiftleft(F.col("i").cast("bigint"), BIN_BITS) + F.col("bin") + BINS // 2).alias("wanted"))
    groups, most = wanted.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("wanted")), F.lit(0))).first()
    values = _tally(attach(wanted, groups, 64 + 8 * most), keys, columns, matrix, True)
    values = values.groupBy(*cell, "bin", "v").agg(F.sum("n").alias("n"))
    values = materialize(values.join(picked, [*cell, "bin"]))
    values = _narrowed(values, [*cell, "bin"], limit)
    ends = _around(values, [*cell, "bin"], "v").select(*cell, "v", "before", (F.col("before") + F.col("n")).alias("_end"), "lo", "hi")
    at = lambda rank: F.max(F.when((F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("_end")), F.col("v")))
    return ends.groupBy(*cell).agg(((at("lo") + at("hi")) / 2).alias("middle"))


def medians(
    chunks: Spread,
    columns: list[str],
    matrix: Matrix,
    params: DataFrame | None = None,
    row_bytes: int = 64,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    limit: int = DISTINCT_LIMIT,
) -> DataFrame:
    """``keys…, middle``: the exact median of each column of ``matrix(cells)`` over all chunks of a group.

    ``chunks`` come from ``Spread.chunks`` with ``rows_per_chunk`` and are settled; ``params`` has at most one row of
    ``row_bytes`` per group, and groups without one are left out. The number of columns may differ between groups. A
    group that is one chunk is answered from it, in the same read; larger ones are read twice.
    """
    keys = chunks.keys
    sized = chunks.sizes.select(*keys, F.col("n").alias("_n"))
    rows = chunks.attach(sized if params is None else params.join(sized, keys), row_bytes)
    whole = per_group(rows.filter(F.col("_n") <= rows_per_chunk), keys, columns, ["middle"], lambda cells: {"middle": middle(matrix(cells))})
    if chunks.largest <= rows_per_chunk:
        return whole
    pieces = rows.filter(F.col("_n") > rows_per_chunk)
    attach = lambda table, groups, size: chunks.with_points(pieces).attach(table, size)
    found = _selected(pieces, keys, columns, matrix, attach, limit)
    cells = F.array_sort(F.collect_list(F.struct("i", "middle")))
    return whole.unionByName(found.groupBy(*keys).agg(F.transform(cells, lambda c: c["middle"]).alias("middle")))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, limit: int = DISTINCT_LIMIT) -> DataFrame:
    """``keys…, out``: the exact median of ``value`` per group; nulls do not count, NaN counts as largest.

    Rows are packed by group inside their tasks, so nothing is shuffled but counts. ``df`` is read twice.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_x", T.ArrayType(T.DoubleType()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("_x", "list")])
            table = table.select([*keys, "_x_list"]).rename_columns([*keys, "_x"])
            yield from table.combine_chunks().to_batches()

    plain = df.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    pieces = plain.mapInArrow(pack, schema)

    def attach(table: DataFrame, groups: int, size: int) -> DataFrame:
        return pieces.join(F.broadcast(table) if fits_broadcast(groups, size) else table, keys)

    found = _selected(pieces, keys, ["_x"], lambda cells: cells["_x"].reshape(-1, 1), attach, limit)
    return found.select(*keys, F.col("middle").alias(out))
