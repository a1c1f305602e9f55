"""Band-pass filter over signal blocks.

The filter is a recursion over time, which no built-in expression states; it runs as matrix products on whole Arrow
batches. ``bandpass`` asks for blocks with so many earlier samples that the start state has died out: no state travels
between rows, and the step is narrow. ``bandpass_joined`` asks for none: a block maps the state at its begin to the one
at its end by an affine map, and a parallel prefix over these maps gives every block the exact state it begins with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.butterworth import bandpass_coefficients, block_filter, settle_length, state_matrices
from ..functions.rules import FILTER_ORDER, HIGH_HZ, LOW_HZ, SAMPLE_HZ
from ..plans.spread import checked_join, materialize
from ..session import KEYS

FAN = 1024  # blocks whose maps are composed in one piece
BATCH_SAMPLES = 4_000_000  # samples filtered at once; bounds a task's memory


def warm_up(low: float = LOW_HZ, high: float = HIGH_HZ, sample_hz: float = SAMPLE_HZ, order: int = FILTER_ORDER) -> int:
    """Samples a block needs before its first useful one; blocks at an interval start need none."""
    return settle_length(bandpass_coefficients(low, high, sample_hz, order)[1])


def bandpass(
    blocks: DataFrame,
    low: float = LOW_HZ,
    high: float = HIGH_HZ,
    sample_hz: float = SAMPLE_HZ,
    order: int = FILTER_ORDER,
    keep_lead: int = 0,
    samples: str = "samples",
) -> DataFrame:
    """Replace ``samples`` by the filtered ``y``; of the leading neighbours only ``keep_lead`` are kept.

    ``abs_sum``, the sum of ``abs(y)`` over the block's own samples, is added for the noise threshold.

    The state is zero at position 0 of an interval. Elsewhere ``first`` must lie at least ``warm_up() + keep_lead``
    before ``start``.
    """
    b, a = bandpass_coefficients(low, high, sample_hz, order)
    settle = settle_length(a)
    kernel = block_filter(b, a)
    kept = [f for f in blocks.schema.fields if f.name != samples]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("abs_sum", T.DoubleType()), T.StructField("y", T.ArrayType(T.DoubleType()))])

    def filtered_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = lambda name: batch.column(batch.schema.get_field_index(name))
        matrix, inside, sizes = _matrix(cell(samples))
        start, first, n_core = (cell(c).to_numpy() for c in ("start", "first", "n_core"))
        filtered = kernel.run(matrix)
        drop = np.maximum(start - first - keep_lead, 0)
        if ((first > 0) & (drop < settle)).any():
            raise ValueError("a block does not carry enough earlier samples for the filter")
        keep = inside & (np.arange(matrix.shape[1]) >= drop[:, None])
        stops = np.concatenate([[0], np.cumsum(sizes - drop)]).astype(np.int32)
        y = pa.ListArray.from_arrays(pa.array(stops), pa.array(filtered[keep]))
        spans = zip(filtered, start - first, n_core)
        sums = pa.array([np.abs(row[at : at + n]).sum() for row, at, n in spans], pa.float64())
        columns = [cell(n) for n in names]
        columns[names.index("first")] = pa.array(first + drop, pa.int64())
        return pa.RecordBatch.from_arrays([*columns, sums, y], names=[*names, "abs_sum", "y"])

    return blocks.mapInArrow(_in_pieces(filtered_rows, samples), schema)


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of samples as the rows of a matrix, which cells are inside a list, and the lists' lengths."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    matrix = np.zeros((len(sizes), int(sizes.max(initial=0))))
    inside = np.arange(matrix.shape[1]) < sizes[:, None]
    matrix[inside] = flat
    return matrix, inside, sizes


def _in_pieces(work, samples: str):
    """``work`` on batches with a bounded number of samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = len(batch.column(batch.schema.get_field_index(samples)).flatten())
            rows = max(1, batch.num_rows * BATCH_SAMPLES // max(held, 1))
            for at in range(0, batch.num_rows, rows):
                yield work(batch.slice(at, rows))

    return run


def _vectors(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def modes(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Poles, and the matrices from a state to its parts along them and back.

    Along its poles a state is only multiplied from step to step. Powers of the state matrix itself would lose half of
    the digits in narrow bands, where poles lie close together.
    """
    poles, basis = np.linalg.eig(state_matrices(b, a)[0].T)
    return poles, basis, np.linalg.inv(basis)


def _complex(column: pa.ListArray) -> np.ndarray:
    """A column of lists of pairs (real, imaginary), all of one length, as the rows of a complex matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(np.complex128).reshape(len(column), -1)


def _begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal ``keys`` begin in sorted rows; nulls are equal."""
    new = np.zeros(max(len(table) - 1, 0), bool)
    for k in keys:
        column = table.column(k).combine_chunks()
        a, b = column.slice(0, len(new)), column.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new |= differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.flatnonzero(np.concatenate([[len(table) > 0], new]))


def _per_run(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work`` on whole runs of equal ``keys``, many at once, as sorted rows and the places where runs begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if batch.num_rows else [], batch.schema)
            table = pa.concat_tables([rest, table]) if rest is not None else table
            begins = _begins(table, keys)
            if len(begins) > 1:  # the last run may go on in the next batch
                yield from work(table.slice(0, begins[-1]).combine_chunks(), begins[:-1]).to_batches()
                table = table.slice(begins[-1])
            rest = table
        if rest is not None and len(rest):
            yield from work(rest.combine_chunks(), np.zeros(1, np.int64)).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(run, schema)


def state_maps(blocks: DataFrame, b: np.ndarray, a: np.ndarray, lead: int = 0, samples: str = "samples") -> DataFrame:
    """``keys…, block, m, z``: the state where the next block's samples begin is ``s · m + z``, with s where this one's do.

    States are given by their parts along the filter's poles, as pairs of real and imaginary part. ``lead`` is the
    number of earlier samples that blocks carry, all but those at the begin of an interval.
    """
    kernel, (poles, basis, _) = block_filter(b, a), modes(b, a)
    schema = T.StructType([*[blocks.schema[k] for k in KEYS], blocks.schema["block"], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in "mz"]])

    def mapped(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = lambda name: batch.column(batch.schema.get_field_index(name))
        matrix, _, sizes = _matrix(cell(samples))
        start, first, n_core = (cell(c).to_numpy().astype(np.int64) for c in ("start", "first", "n_core"))
        length = np.maximum(start + n_core - lead, 0) - first
        if (length > sizes).any() or (length < 0).any() or (first != np.maximum(start - lead, 0)).any():
            raise ValueError("blocks do not carry the earlier samples that lead says")
        held = np.zeros((len(sizes), int(length.max(initial=0))))
        for row, n in enumerate(length):
            held[row, held.shape[1] - n :] = matrix[row, :n]
        m, z = poles ** length[:, None], kernel.end_state(held) @ basis
        made = [_vectors(np.ascontiguousarray(v).view(np.float64)) for v in (m, z)]
        return pa.RecordBatch.from_arrays([*[cell(k) for k in KEYS], cell("block"), *made], names=schema.names)

    used = blocks.select(*KEYS, "block", "start", "first", "n_core", samples)
    return used.mapInArrow(_in_pieces(mapped, samples), schema)


def entry_states(maps: DataFrame, fan: int = FAN) -> DataFrame:
    """``keys…, block, state`` where each block's samples begin, from its interval's zero state, for any number of blocks.

    Runs of ``fan`` blocks are composed to one map each, runs of runs likewise, until one run is left; then states go
    back down. So a group is at most ``fan`` small rows, and the number of levels is logarithmic. ``maps`` is written.
    """
    kinds = ", ".join(f"{k} {maps.schema[k].dataType.simpleString()}" for k in KEYS)

    def steps(begins: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which runs have an n-th block, and its row: all runs go on by one block together."""
        sizes = np.diff(np.append(begins, rows))
        for n in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > n)
            yield live, begins[live] + n

    def walk(table: pa.Table, begins: np.ndarray) -> pa.Table:
        m, z = (_complex(table.column(c).combine_chunks()) for c in "mz")
        out, state = np.empty_like(m), np.zeros((len(begins), m.shape[1]), np.complex128)
        if "begin" in table.column_names:
            state = _complex(table.column("begin").combine_chunks())[begins]
        for live, at in steps(begins, len(table)):
            out[at] = state[live]
            state[live] = state[live] * m[at] + z[at]
        return table.select([*KEYS, "block"]).append_column("state", _vectors(out.view(np.float64)))

    def compose(table: pa.Table, begins: np.ndarray) -> pa.Table:
        m, z = (_complex(table.column(c).combine_chunks()) for c in "mz")
        whole, state = np.ones((len(begins), m.shape[1]), np.complex128), np.zeros((len(begins), m.shape[1]), np.complex128)
        for live, at in steps(begins, len(table)):
            whole[live], state[live] = whole[live] * m[at], state[live] * m[at] + z[at]
        heads = table.select([*KEYS, "_run"]).take(pa.array(begins))
        return heads.append_column("m", _vectors(whole.view(np.float64))).append_column("z", _vectors(state.view(np.float64)))

    out = f"{kinds}, block bigint, state array<double>"
    if (maps.agg(F.max("block")).first()[0] or 0) < fan:
        return _per_run(maps, KEYS, walk, out)
    runs = maps.withColumn("_run", F.floor(F.col("block") / fan))
    upper = _per_run(runs, [*KEYS, "_run"], compose, f"{kinds}, _run bigint, m array<double>, z array<double>")
    begins = entry_states(materialize(upper.withColumnRenamed("_run", "block")), fan)
    begins = begins.select(*KEYS, F.col("block").alias("_run"), F.col("state").alias("begin"))
    return _per_run(runs.join(begins, [*KEYS, "_run"]), [*KEYS, "_run"], walk, out)


def bandpass_joined(
    blocks: DataFrame,
    low: float = LOW_HZ,
    high: float = HIGH_HZ,
    sample_hz: float = SAMPLE_HZ,
    order: int = FILTER_ORDER,
    lead: int = 0,
    samples: str = "samples",
    fan: int = FAN,
) -> DataFrame:
    """As ``bandpass``, exact for blocks of any length, also for narrow bands, without samples to warm up on.

    The filter's direct form sets a limit: a band of a few hertz near zero, at tens of kilohertz, is beyond what its
    coefficients can say in doubles, here as in any other evaluation of them.

    ``lead`` is the number of earlier samples that the blocks carry for later steps; it may be zero, and all are kept.
    Blocks are read twice: for their maps, two complex numbers for each pole, and for the filter.
    """
    b, a = bandpass_coefficients(low, high, sample_hz, order)
    kernel, back = block_filter(b, a), modes(b, a)[2]
    states = materialize(entry_states(materialize(state_maps(blocks, b, a, lead, samples)), fan))
    kept = [f for f in blocks.schema.fields if f.name != samples]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("abs_sum", T.DoubleType()), T.StructField("y", T.ArrayType(T.DoubleType()))])

    def filtered_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = lambda name: batch.column(batch.schema.get_field_index(name))
        matrix, inside, sizes = _matrix(cell(samples))
        filtered = kernel.run(matrix, (_complex(cell("state")) @ back).real)
        y = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(filtered[inside]))
        skip, n_core = cell("start").to_numpy() - cell("first").to_numpy(), cell("n_core").to_numpy()
        sums = pa.array([np.abs(row[at : at + n]).sum() for row, at, n in zip(filtered, skip, n_core)], pa.float64())
        return pa.RecordBatch.from_arrays([*[cell(n) for n in names], sums, y], names=[*names, "abs_sum", "y"])

    joined = checked_join(blocks, states, [*KEYS, "block"], rows=states.count(), row_bytes=128)
    return joined.select(*names, samples, "state").mapInArrow(_in_pieces(filtered_rows, samples), schema)
