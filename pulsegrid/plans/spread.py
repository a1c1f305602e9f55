"""Plan building blocks shared by the operators: durable cuts, size-checked joins and skew-proof grouping.

Rules kept here, once, for every operator:

* lineage is cut with a reliable ``checkpoint()`` only;
* a side is broadcast only after its rows were counted and found small; otherwise it is an equi-join whose key
  carries a bucket or salt, so that one hot group is spread over many tasks;
* a group is never gathered whole: it is cut into salts (for joins) or chunks (for numpy work) of bounded size.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_folder

BROADCAST_BYTES = 64 * 1024 * 1024
HOLD_BYTES = 4 * 1024 * 1024
MAX_HOT_GROUPS = 50_000
ROWS_PER_SALT = 500_000
ROWS_PER_CHUNK = 1024


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from the written rows."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write wide rows once, as columns, to the checkpoint folder, and continue from what is written.

    Later steps read only the columns they name; ``materialize`` would have them read whole rows. Files stay until the
    folder is cleared.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def task_count(df: DataFrame, rows: int) -> int:
    """Partitions for rows that are read many times: no fewer than there are cores, and no more than hold 16 rows."""
    session = df.sparkSession
    cores = session.sparkContext.defaultParallelism
    return max(cores, min(int(session.conf.get("spark.sql.shuffle.partitions")), rows // 16))


def hold(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Iteration state of at most ``rows`` rows: kept as a local table while small, written out beyond that.

    ``rows`` and ``row_bytes`` are bounds known before the state is computed (groups times parameters).
    """
    if rows * row_bytes > HOLD_BYTES:
        return materialize(df)
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    A plain projection may be merged into its consumers, which would compute an expensive array expression again in
    every lambda call and in every pushed-down filter. A one-element generator is a boundary to those rules.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def checked_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    *,
    rows: int,
    row_bytes: int = 64,
    how: str = "inner",
) -> DataFrame:
    """Join a side of ``rows`` counted rows: broadcast while it fits, shuffled by ``on`` beyond that.

    For the shuffled form ``on`` must not be hot on its own; see ``position_join`` and ``Spread.attach``.
    """
    return big.join(F.broadcast(small) if fits_broadcast(rows, row_bytes) else small, on, how)


def position_join(
    big: DataFrame,
    per_group: DataFrame,
    keys: list[str],
    *,
    rows: int,
    position: Column,
    length: Column,
    stride: int,
    row_bytes: int = 64,
) -> DataFrame:
    """Join one row per group onto rows that carry a position inside the group, without a hot key.

    While ``per_group`` fits, it is broadcast. Beyond that, both sides get ``floor(position / stride)`` as a
    further key; the group row is repeated once per stride of its ``length``. A long group is thus spread over as
    many keys as it has strides, and a short one is repeated once.
    """
    if fits_broadcast(rows, row_bytes):
        return big.join(F.broadcast(per_group), keys)
    spread = per_group.withColumn("_stride", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(length / stride))))
    return big.withColumn("_stride", F.floor(position / stride)).join(spread, [*keys, "_stride"]).drop("_stride")


@dataclass(frozen=True)
class Spread:
    """Points of many groups, salted so that no (group, salt) is large, with the exact group sizes."""

    points: DataFrame
    sizes: DataFrame  # keys, n, n_salts; checkpointed
    keys: list[str]
    groups: int
    largest: int
    total: int

    def attach(self, params: DataFrame, row_bytes: int = 64, how: str = "inner") -> DataFrame:
        """Give every point its group's row of ``params`` (at most one row per group)."""
        if fits_broadcast(self.groups, row_bytes):
            return self.points.join(F.broadcast(params), self.keys, how)
        salted = (
            params.join(self.sizes.select(*self.keys, "n_salts"), self.keys)
            .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_salts") - 1)))
            .drop("n_salts")
        )
        return self.points.join(salted, [*self.keys, "salt"], how)

    def hold(self, params: DataFrame, row_bytes: int = 64) -> DataFrame:
        """Cut the lineage of a table with at most one row per group."""
        return hold(params, self.groups, row_bytes)

    def settle(self) -> Spread:
        """Write the points once, for a job that reads them many times. A checkpoint keeps its partitioning."""
        return replace(self, points=materialize(self.points))

    def chunks(self, columns: list[str], row_bytes: int = 64, rows_per_chunk: int = ROWS_PER_CHUNK) -> Spread:
        """Pack points into rows of about ``rows_per_chunk`` points: one flat array per column of ``columns``.

        The chunk of a point is a hash of its id, so it does not depend on the partitioning of the input, and a
        group of n points becomes ceil(n / rows_per_chunk) rows. While per-group parameters of ``row_bytes`` can be
        broadcast, chunks are spread evenly over all tasks. Otherwise they are placed by (keys, salt): each later
        ``attach`` then shuffles the parameters only.
        """
        sized = self.attach(self.sizes.select(*self.keys, F.col("n").alias("_n")))
        chunk = F.pmod(F.xxhash64("event_id", F.lit("chunk")), F.ceil(F.col("_n") / rows_per_chunk))
        place = [*self.keys, "salt"] + (["chunk"] if fits_broadcast(self.groups, row_bytes) else [])
        nested = {f.name for f in self.points.schema.fields if isinstance(f.dataType, T.ArrayType)}
        cells = [(F.flatten(F.col("_rows")[c]) if c in nested else F.col("_rows")[c]).alias(c) for c in columns]
        packed = (
            sized.withColumn("chunk", chunk)
            .repartition(task_count(sized, self.total // rows_per_chunk + self.groups), *place)
            .groupBy(*self.keys, "salt", "chunk")
            .agg(F.collect_list(F.struct("event_id", *columns)).alias("_rows"))
            .select(*self.keys, "salt", "chunk", F.col("_rows")["event_id"].alias("event_ids"), *cells)
        )
        return replace(self, points=packed)

    def pooled(self, keys: list[str]) -> Spread:
        """The same rows in the larger groups of ``keys``, a part of the present keys, salted anew.

        The former keys stay on the rows. Only groups that need several salts are looked up, in a bounded table.
        """
        sizes = materialize(self.sizes.groupBy(*keys).agg(F.sum("n").alias("n")))
        groups, largest = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
        limit = max(ROWS_PER_SALT, math.ceil(self.total / MAX_HOT_GROUPS))
        sizes = sizes.withColumn("n_salts", F.ceil(F.col("n") / limit))
        points = self.points.withColumn("salt", F.lit(0).cast("bigint"))
        if largest > limit:
            part = "chunk" if "chunk" in self.points.columns else "event_id"
            hot = F.broadcast(sizes.filter("n_salts > 1").select(*keys, "n_salts"))
            salt = F.pmod(F.xxhash64(*self.keys, part, F.lit("pool")), F.coalesce("n_salts", F.lit(1).cast("bigint")))
            points = points.join(hot, keys, "left").withColumn("salt", salt).drop("n_salts")
        return Spread(points, sizes, list(keys), groups, largest, self.total)

    def by_rows(self, rows_per_chunk: int = ROWS_PER_CHUNK) -> tuple[Spread, Spread | None]:
        """Chunk rows of the groups that are one row each, and those of all other groups (None if there are none)."""
        one = (F.col("n") <= rows_per_chunk) & (F.col("n_salts") == 1)
        if self.sizes.filter(~one).isEmpty():
            return self, None
        part = lambda which: self.with_points(self.attach(self.sizes.filter(which).select(*self.keys)))
        return part(one), part(~one)

    def with_points(self, points: DataFrame) -> Spread:
        return replace(self, points=points)


def spread(points: DataFrame, keys: list[str], rows_per_salt: int = ROWS_PER_SALT) -> Spread:
    """Count the groups of ``points`` (which has ``event_id``, unique per group) and salt the large ones.

    Only groups above ``rows_per_salt`` need a lookup, and the limit is raised with the total so that at most
    ``MAX_HOT_GROUPS`` groups can exceed it: the broadcast table of hot groups has a proven bound.
    """
    counted = materialize(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    groups, largest, total = counted.agg(
        F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    limit = max(rows_per_salt, math.ceil(total / MAX_HOT_GROUPS))
    sizes = counted.withColumn("n_salts", F.ceil(F.col("n") / limit))
    if largest > limit:
        hot = F.broadcast(sizes.filter("n_salts > 1").select(*keys, "n_salts"))
        salt = F.pmod(F.xxhash64("event_id", F.lit("salt")), F.coalesce("n_salts", F.lit(1).cast("bigint")))
        points = points.join(hot, keys, "left").withColumn("salt", salt).drop("n_salts")
    else:
        points = points.withColumn("salt", F.lit(0).cast("bigint"))
    return Spread(points, sizes, list(keys), groups, largest, total)


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], out: str = "sample", window_limit: int = 2_000_000
) -> DataFrame:
    """Exact 0-based position of every row within its group, in ``order``, whatever the group sizes.

    When the largest group is at most ``window_limit`` rows, a window does it in one shuffle. Otherwise rows are
    range-partitioned on (keys, order), so that a hot group spans many partitions; the position is then the
    offset within the partition plus the rows of the same group in earlier partitions. The second form needs
    stable partitions, hence the checkpoint.
    """
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= window_limit:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        return df.withColumn(out, rank.cast("bigint") - 1)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, math.ceil(largest / window_limit) * 2)
    ranged = materialize(
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
    )
    runs = ranged.groupBy(*keys, "_part").agg(F.min("_at").alias("_begin"), F.count(F.lit(1)).alias("_len"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = materialize(runs.withColumn("_before", F.coalesce(F.sum("_len").over(before), F.lit(0))).drop("_len"))
    placed = checked_join(ranged, runs, [*keys, "_part"], rows=runs.count())
    return placed.withColumn(out, F.col("_at") - F.col("_begin") + F.col("_before")).drop(
        "_at", "_part", "_begin", "_before"
    )
