"""Channel series from any table: exact sample positions, then overlapping signal blocks.

A block row holds ``n_core`` samples of one channel from position ``start`` on, plus neighbours on both sides, so
that every later step (filter warm-up, windows that cross a block edge) is local to the row:

    keys…, block BIGINT, start BIGINT, n_core INT, first BIGINT, <values> ARRAY

``first`` is the position of the first array element; ``first <= start``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spread import materialize, number_rows, position_join
from ..session import KEYS


def series_from_table(
    df: DataFrame,
    channel: Column,
    order: list[str],
    value: Column,
    recording: str = "table",
    window_limit: int = 2_000_000,
) -> DataFrame:
    """``recording, interval_id, channel, sample, value`` from a table; ``order`` must order each channel fully."""
    rows = df.select(
        F.lit(recording).alias("recording"),
        F.lit(0).alias("interval_id"),
        channel.alias("channel"),
        *order,
        value.alias("value"),
    )
    return number_rows(rows, KEYS, order, "sample", window_limit).select(*KEYS, "sample", "value")


def split_intervals(series: DataFrame, interval_samples: int) -> DataFrame:
    """Cut a series into intervals of a fixed number of samples; ``sample`` counts from 0 in each."""
    return series.withColumn("interval_id", F.floor(F.col("sample") / interval_samples).cast("int")).withColumn(
        "sample", F.pmod("sample", F.lit(interval_samples))
    )


def centre(series: DataFrame, write: bool = True) -> DataFrame:
    """Whole-number series around its floored mean, per channel interval; a hot channel is spread by position.

    The series is written once, since numbering its rows is the expensive part and it is read twice here. With
    ``write=False`` it is not: the means need no positions, so Spark leaves the numbering out of their plan, and a
    consumer that reads the result once numbers the rows once. Only for keys that do not depend on the position.
    """
    series = materialize(series) if write else series
    means = materialize(
        series.groupBy(*KEYS).agg(F.floor(F.sum("value") / F.count("value")).alias("_mean"), F.count("value").alias("_n"))
    )
    joined = position_join(
        series, means, KEYS, rows=means.count(), position=F.col("sample"), length=F.col("_n"), stride=1 << 20
    )
    return joined.select(*KEYS, "sample", (F.col("value") - F.col("_mean")).cast("double").alias("value"))


def first_interval(df: DataFrame) -> DataFrame:
    """Only the first interval of each recording."""
    return df.filter("interval_id = 0")


def with_time(df: DataFrame, sample_hz: float, position: str = "sample") -> DataFrame:
    """Seconds since the start of the interval."""
    return df.withColumn("seconds", F.col(position) / F.lit(float(sample_hz)))


def signal_blocks(
    series: DataFrame, block_len: int, lead: int = 0, tail: int = 0, values: str = "samples"
) -> DataFrame:
    """Blocks of ``block_len`` samples with ``lead`` and ``tail`` neighbours, in one shuffle on (keys, block).

    Each sample row is sent to its own block and to every block that needs it as a neighbour, so no window over a
    whole channel is needed and a group is at most ``lead + block_len + tail`` rows.
    """
    sample = F.col("sample")
    covering = F.sequence(
        F.greatest(F.lit(0).cast("bigint"), F.floor((sample - tail) / block_len)), F.floor((sample + lead) / block_len)
    )
    own = F.floor(sample / block_len)
    return (
        series.withColumn("block", F.explode(covering))
        .groupBy(*KEYS, "block")
        .agg(
            F.count_if(own == F.col("block")).cast("int").alias("n_core"),
            F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("_rows"),
        )
        .filter("n_core > 0")
        .select(
            *KEYS,
            "block",
            (F.col("block") * block_len).alias("start"),
            "n_core",
            F.get("_rows", F.lit(0))["sample"].alias("first"),
            F.transform("_rows", lambda r: r["value"]).alias(values),
        )
    )


def explode_blocks(blocks: DataFrame, values: str = "samples") -> DataFrame:
    """Back to one row per sample: the core of each block only."""
    skip = (F.col("start") - F.col("first")).cast("int")
    core = F.slice(values, skip + 1, F.col("n_core"))
    return blocks.select(*KEYS, "block", "start", F.posexplode(core).alias("_at", "value")).select(
        *KEYS, "block", (F.col("start") + F.col("_at")).alias("sample"), "value"
    )
