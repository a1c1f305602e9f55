"""Event detection on signal blocks: threshold, windows, alignment, de-duplication, snippets.

The dense comparison with the threshold is an Arrow function over whole batches (measured: array lambdas cost far
more per sample). What follows is sparse and stays in Catalyst array expressions. A block
sees a fixed reach past its core, which is enough to decide every event but one: whether the last candidate of a
channel is followed by any other. That is answered by one small aggregate per channel (or inside the row, when a
block holds its whole interval).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spread import materialize, pin, position_join
from ..session import KEYS

# Fixed values of the workload.
WINDOW = 50
FACTOR = 8.0
OFFSET = 20
MAX_THRESHOLD = 1000.0

STRIDE = 1 << 20  # samples per bucket when a per-channel table is too large to broadcast


def lead_needed(window: int = WINDOW, offset: int = OFFSET) -> int:
    """Filtered samples needed before the core: a snippet reaches this far back from its peak."""
    return max(window - offset, 0)


def tail_needed(window: int = WINDOW, offset: int = OFFSET) -> int:
    """Samples needed after the core: later candidates within 2W+1, with windows of 2W, or the snippet's end."""
    return max(4 * window + 2, 3 * window + offset)


@F.arrow_udf(T.DoubleType())
def _span_abs_sum(values: pa.Array, begin: pa.Array, size: pa.Array) -> pa.Array:
    at = values.offsets.to_numpy()[:-1] + begin.to_numpy()
    flat = np.abs(values.values.to_numpy(zero_copy_only=False))
    return pa.array([flat[b : b + n].sum() for b, n in zip(at, size.to_numpy())], pa.float64())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _above(values: pa.Array, begin: pa.Array, end: pa.Array, level: pa.Array) -> pa.Array:
    offsets = values.offsets.to_numpy()
    flat = values.values.to_numpy(zero_copy_only=False)
    hits = []
    for at, b, e, limit in zip(offsets[:-1], begin.to_numpy(), end.to_numpy(), level.to_numpy(zero_copy_only=False)):
        b, e = max(int(b), 0), max(int(e), 0)
        hits.append(b + np.flatnonzero(flat[at + b : at + e] > limit))
    stops = np.concatenate([[0], np.cumsum([len(h) for h in hits])]).astype(np.int32)
    found = np.concatenate([np.empty(0, np.int64), *hits]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(found))


def absolute_sum(values: str = "y") -> Column:
    """Sum of absolute values over the block's own samples, without neighbours."""
    return _span_abs_sum(values, (F.col("start") - F.col("first")).cast("int"), F.col("n_core").cast("int"))


def _with_abs_sum(blocks: DataFrame, values: str) -> DataFrame:
    """The filter leaves ``abs_sum`` in passing; for other blocks it is computed here."""
    return blocks if "abs_sum" in blocks.columns else blocks.withColumn("abs_sum", absolute_sum(values))


def core(values: str = "y") -> Column:
    """The block's own samples, without neighbours."""
    return F.slice(values, (F.col("start") - F.col("first")).cast("int") + 1, F.col("n_core"))


def noise_thresholds(blocks: DataFrame, factor: float = FACTOR, values: str = "y") -> DataFrame:
    """Per channel and interval: sample count and ``mean(abs(y)) * factor``, with partial sums before the shuffle."""
    if "abs_sum" in blocks.columns:
        sums = blocks.groupBy(*KEYS).agg(F.sum("n_core").cast("bigint").alias("n_samples"), F.sum("abs_sum").alias("_abs"))
    else:
        samples = blocks.select(*KEYS, F.explode(core(values)).alias("_v"))
        sums = samples.groupBy(*KEYS).agg(F.count("_v").alias("n_samples"), F.sum(F.abs("_v")).alias("_abs"))
    return sums.select(*KEYS, "n_samples", (F.col("_abs") / F.col("n_samples") * F.lit(float(factor))).alias("thresh"))


def with_thresholds(
    blocks: DataFrame, factor: float = FACTOR, values: str = "y", whole: bool = False
) -> tuple[DataFrame, int]:
    """Blocks with ``n_samples`` and ``thresh``, and the number of channel intervals (0 when not counted).

    ``whole`` says that each row holds a whole channel interval: the threshold is then computed in the row and
    nothing is shuffled or scanned twice.
    """
    if whole:
        n = F.col("n_core").cast("bigint")
        level = F.col("abs_sum") / n * F.lit(float(factor))
        return _with_abs_sum(blocks, values).withColumn("n_samples", n).withColumn("thresh", level), 0
    levels = materialize(noise_thresholds(blocks, factor, values))
    rows = levels.count()
    joined = position_join(
        blocks,
        levels,
        KEYS,
        rows=rows,
        position=F.col("start"),
        length=F.col("n_samples"),
        stride=STRIDE,
    )
    return joined, rows


def crossing_positions(window: int, reach: int, values: str = "y") -> Column:
    """Array indexes of the samples above the threshold, away from both interval edges.

    The core and ``reach`` further samples are looked at; a position must satisfy ``W < pos < n - (W + 1)``. The
    comparison is strict, on the positive side only.
    """
    first = F.col("first")
    begin = F.greatest(F.col("start"), F.lit(window + 1)) - first
    end = F.least(F.col("start") + F.col("n_core") + reach, F.col("n_samples") - (window + 1)) - first
    return _above(values, begin.cast("int"), F.least(end.cast("int"), F.size(values)), F.col("thresh"))


def threshold_crossings(blocks: DataFrame, window: int = WINDOW, factor: float = FACTOR, values: str = "y") -> DataFrame:
    """One row per sample above the threshold: keys, ``pos``, ``value``."""
    levelled, _ = with_thresholds(blocks, factor, values)
    hits = F.transform(
        "_at",
        lambda j: F.struct((F.col("first") + j).alias("pos"), F.get(F.col(values), j).alias("value")),
    )
    crossed = levelled.withColumn("_at", crossing_positions(window, 0, values))
    return pin(crossed, "_hits", hits).select(*KEYS, F.explode("_hits").alias("hit")).select(*KEYS, "hit.pos", "hit.value")


def with_candidates(blocks: DataFrame, window: int, max_threshold: float, reach: int, values: str = "y") -> DataFrame:
    """Blocks with ``_c``, an array of ``(pos, peak)``: crossings whose forward window stays below ``max_threshold``, moved to its maximum.

    The window holds 2·W samples from the crossing on and is shorter at the end of the data; the first maximum
    counts on ties.
    """
    y = F.col(values)
    first = F.col("first")
    windows = F.transform(
        "_at", lambda j: F.struct(j.alias("j"), F.slice(y, j + 1, 2 * window).alias("win"))
    )
    topped = F.transform(
        windows, lambda s: F.struct(s["j"].alias("j"), s["win"].alias("win"), F.array_max(s["win"]).alias("top"))
    )
    calm = F.filter(topped, lambda s: s["top"] < F.lit(float(max_threshold)))
    peaks = F.transform(
        calm,
        lambda s: F.struct(
            (first + s["j"]).alias("pos"),
            (first + s["j"] + F.array_position(s["win"], s["top"]) - 1).alias("peak"),
        ),
    )
    return pin(blocks.withColumn("_at", crossing_positions(window, reach, values)), "_c", peaks)


def aligned_peaks(
    blocks: DataFrame,
    window: int = WINDOW,
    factor: float = FACTOR,
    max_threshold: float = MAX_THRESHOLD,
    values: str = "y",
) -> DataFrame:
    """One row per accepted crossing: keys, ``pos``, ``peak``; several crossings may share a peak."""
    levelled, _ = with_thresholds(blocks, factor, values)
    found = with_candidates(levelled, window, max_threshold, 0, values)
    return found.select(*KEYS, F.explode("_c").alias("c")).select(*KEYS, "c.pos", "c.peak")


def detect_events(
    blocks: DataFrame,
    window: int = WINDOW,
    factor: float = FACTOR,
    offset: int = OFFSET,
    max_threshold: float = MAX_THRESHOLD,
    values: str = "y",
    whole: bool = False,
    keep_last: bool = False,
    min_events: int = 1,
) -> DataFrame:
    """De-duplicated events with snippets: keys, ``event_id`` (= ``peak``), ``pos``, ``peak``, ``n_samples``, ``wave``.

    A candidate stays if the next candidate's peak lies more than one sample later; the last candidate of a
    channel has no next one and is dropped (``keep_last=True`` keeps it). Snippets are
    ``[peak - (W - offset), peak + W + offset)``; an incomplete one is dropped after de-duplication. Channel
    intervals with fewer than ``min_events`` events are left out.
    Blocks need ``lead_needed`` and ``tail_needed`` neighbours.
    """
    levelled, rows = with_thresholds(blocks, factor, values, whole)
    y, first = F.col(values), F.col("first")
    found = with_candidates(levelled, window, max_threshold, 2 * window + 1, values)
    judged = F.zip_with(
        F.col("_c"),
        F.slice("_c", 2, F.greatest(F.size("_c"), F.lit(1))),
        lambda a, b: F.struct(
            a["pos"].alias("pos"),
            a["peak"].alias("peak"),
            b["pos"].isNull().alias("open"),
            (b["pos"].isNull() | (b["peak"] - a["peak"] > 1)).alias("keep"),
        ),
    )
    core_end = F.col("start") + F.col("n_core")
    kept = F.filter(judged, lambda e: e["keep"] & (e["pos"] < core_end))
    snippets = F.transform(
        kept,
        lambda e: F.struct(
            e["pos"].alias("pos"),
            e["peak"].alias("peak"),
            e["open"].alias("open"),
            F.slice(y, (e["peak"] - (window - offset) - first + 1).cast("int"), 2 * window).alias("wave"),
        ),
    )
    if whole:
        snippets = F.filter(snippets, lambda e: (F.lit(keep_last) | ~e["open"]) & (F.size(e["wave"]) == 2 * window))
    found = pin(found, "_events", snippets).select(*KEYS, "n_samples", "_events")
    if whole:
        found = found.filter(F.size("_events") >= min_events)
    events = found.select(*KEYS, "n_samples", F.explode("_events").alias("e")).select(*KEYS, "n_samples", "e.*")
    if not whole:
        events = _settle_channels(events, rows, 2 * window, keep_last, min_events)
    return events.select(*KEYS, F.col("peak").alias("event_id"), "pos", "peak", "n_samples", "wave")


def _settle_channels(events: DataFrame, rows: int, width: int, keep_last: bool, min_events: int) -> DataFrame:
    """Drop the last event of each channel interval, incomplete snippets, and channels with too few events.

    ``open`` marks events with no later candidate in sight of their block; the channel's last event is the one
    of them with the highest position. One aggregate per channel answers that and the count.
    """
    complete = F.size("wave") == width
    events = materialize(events)
    facts = events.groupBy(*KEYS).agg(
        F.max("pos").alias("_last"),
        F.count_if(complete).alias("_n"),
        F.max_by(complete, "pos").cast("int").alias("_last_complete"),
        F.max("n_samples").alias("_len"),
    )
    if not keep_last:
        facts = facts.withColumn("_n", F.col("_n") - F.col("_last_complete"))
    facts = materialize(facts.filter(F.col("_n") >= min_events).drop("_n", "_last_complete"))
    joined = position_join(
        events, facts, KEYS, rows=rows, position=F.col("pos"), length=F.col("_len"), stride=STRIDE
    )
    stays = complete if keep_last else complete & (F.col("pos") < F.col("_last"))
    return joined.filter(stays).drop("_last", "_len")


def normalise_all(events: DataFrame) -> DataFrame:
    """``(w + min) / (max + min)`` per waveform; with a zero denominator there is no result: ``wave`` is null."""
    low, high = F.array_min("wave"), F.array_max("wave")
    scaled = F.transform("wave", lambda v: (v + F.col("_low")) / F.col("_span"))
    marked = events.withColumn("_low", low).withColumn("_span", high + low)
    return marked.withColumn("wave", F.when(F.col("_span") != 0, scaled)).drop("_low", "_span")


def normalise_waves(events: DataFrame) -> DataFrame:
    """``normalise_all`` without the events that have no result."""
    return normalise_all(events).filter("wave is not null")


def flat_waves(events: DataFrame) -> DataFrame:
    """The events that ``normalise_waves`` drops."""
    return events.filter(F.array_max("wave") + F.array_min("wave") == 0)
