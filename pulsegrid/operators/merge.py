"""Merging of clusters across neighbouring channels, minimum support, and unit labels.

Clusters are represented by their summary rows (count, vector sum, channel span); member vectors are only read by
the robust separation.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import MERGE_PASSES, MINIMAL_SUPPORT, SIMILARITY, VICINITY
from ..functions.vectors import distance, norm, scale, subtract, sum_by_position
from ..plans.select import DISTINCT_LIMIT, medians
from ..plans.spread import ROWS_PER_CHUNK, checked_join, hold, materialize, number_rows, pin, spread
from ..session import KEYS
from .moments import points_of

SCOPE = KEYS[:2]
ISLAND_LIMIT = 2_000_000  # summary rows one task may merge in order
MUTUAL_LIMIT = 50_000  # summary rows one task may merge by mutual neighbours


def centroid(total: Column, n: Column) -> Column:
    return scale(total, F.lit(1.0) / n)


def vicinity_pairs(summary: DataFrame, vicinity: int = VICINITY, later: DataFrame | None = None) -> DataFrame:
    """Pairs (earlier, later) with ``later.e_chn - earlier.s_chn <= vicinity``: a range join as an equi-join.

    Channels are bucketed by ``vicinity + 1``, so the start of a partner lies in one of at most two buckets. ``ord``
    must follow the start channel. A cluster meets the clusters of at most ``vicinity + 1`` channels, ten each.
    ``later`` restricts the later ones to another table.
    """
    step = vicinity + 1
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("ord", "n", "sum", "s_chn", "e_chn")]
    earlier = summary.select(*SCOPE, *side("a"), F.floor(F.col("s_chn") / step).alias("_bucket"))
    reach = F.sequence(F.floor((F.col("e_chn") - vicinity) / step), F.floor(F.col("e_chn") / step))
    later = (summary if later is None else later).select(*SCOPE, *side("b"), F.explode(reach).alias("_bucket"))
    near = (F.col("a_ord") < F.col("b_ord")) & (F.col("b_e_chn") - F.col("a_s_chn") <= vicinity)
    gap = distance(centroid(F.col("a_sum"), F.col("a_n")), centroid(F.col("b_sum"), F.col("b_n")))
    return earlier.join(later, [*SCOPE, "_bucket"]).filter(near).drop("_bucket").withColumn("distance", gap)


def nearest_earlier(pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """For each later cluster its nearest earlier one below ``similarity``; the latest wins ties."""
    best = F.min(F.struct("distance", (-F.col("a_ord")).alias("_back"))).alias("_best")
    return (
        pairs.filter(F.col("distance") < similarity)
        .groupBy(*SCOPE, "b_ord")
        .agg(best)
        .select(*SCOPE, "b_ord", (-F.col("_best._back")).alias("a_ord"), F.col("_best.distance").alias("distance"))
    )


def islands(summary: DataFrame, vicinity: int = VICINITY) -> DataFrame:
    """Summary rows with ``island``: runs of clusters whose start channels are at most ``vicinity`` apart.

    No pair spans two islands, so they merge independently. The window sees each channel of an interval once.
    """
    starts = summary.select(*SCOPE, "s_chn").distinct()
    order = W.partitionBy(*SCOPE).orderBy("s_chn")
    opens = F.coalesce(F.col("s_chn") - F.lag("s_chn").over(order) > vicinity, F.lit(True)).cast("int")
    numbered = starts.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(order)).drop("_opens")
    return summary.join(numbered, [*SCOPE, "s_chn"]).select(*summary.columns, "island")


def _merge_in_order(
    sums: np.ndarray, counts: np.ndarray, starts: np.ndarray, ends: np.ndarray, vicinity: int, similarity: float, passes: int, strict: bool
) -> np.ndarray:
    """Index of the cluster each one ends up with, for one island in order.

    A pass takes clusters in order; each joins the nearest of the units so far whose start is within the vicinity
    of its end, or opens a unit. Starts never decrease, so the eligible units are the last ones. Passes repeat
    until one merges nothing.
    """
    parent = np.arange(len(counts))
    units = list(range(len(counts)))  # founding cluster of each unit
    sums, counts, ends = sums.copy(), counts.astype(np.int64), ends.copy()
    for _ in range(passes):
        kept: list[int] = []
        kept_starts: list[int] = []
        for unit in units:
            low = bisect_left(kept_starts, ends[unit] - vicinity)
            target = None
            if low < len(kept):
                pool = np.array(kept[low:])
                gaps = np.linalg.norm(sums[pool] / counts[pool, None] - sums[unit] / counts[unit], axis=1)
                if gaps.min() < similarity:
                    target = pool[np.flatnonzero(gaps == gaps.min())[-1]]
            if target is None:
                kept.append(unit)
                kept_starts.append(starts[unit])
                continue
            sums[target] += sums[unit]
            counts[target] += counts[unit]
            ends[target] = max(ends[target], ends[unit]) if strict else ends[unit]
            parent[unit] = target
        if len(kept) == len(units):
            break
        units = kept
    # A cluster joins an earlier one, so one walk in order resolves every chain.
    for i in range(len(parent)):
        parent[i] = parent[parent[i]]
    return parent


def merge_greedy(
    summary: DataFrame,
    vicinity: int = VICINITY,
    similarity: float = SIMILARITY,
    max_passes: int = MERGE_PASSES,
    strict_span: bool = False,
    island_limit: int = ISLAND_LIMIT,
) -> DataFrame:
    """``recording, interval_id, ord, unit``: the order-dependent merge, exact, one task per island.

    ``unit`` is the ``ord`` of the founding cluster. A merged unit keeps its start and takes the newcomer's end
    channel (``strict_span``: the larger of both). An island holds at most ten summary rows per channel of one
    interval, so this method is for recordings, whose device bounds the channels; an island above ``island_limit`` rows
    is refused. ``merge_mutual``, the default, has no order and no such bound.
    """
    placed = materialize(islands(summary, vicinity))
    largest = placed.groupBy(*SCOPE, "island").count().agg(F.max("count")).first()[0] or 0
    if largest > island_limit:
        raise ValueError(f"an island of {largest} clusters is too long to merge in order; use method='mutual'")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        found = _merge_in_order(
            np.stack(rows["sum"].to_numpy()),
            rows["n"].to_numpy(),
            rows["s_chn"].to_numpy(),
            rows["e_chn"].to_numpy(),
            vicinity,
            similarity,
            max_passes,
            strict_span,
        )
        ords = rows["ord"].to_numpy()
        return pd.DataFrame({c: rows[c].to_numpy() for c in SCOPE} | {"ord": ords, "unit": ords[found]})

    schema = f"recording string, interval_id int, ord {placed.schema['ord'].dataType.simpleString()}, unit bigint"
    return placed.groupBy(*SCOPE, "island").applyInPandas(merge, schema)


def mutual_partners(pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``recording, interval_id, ord, unit`` of one round: pairs that are each other's nearest, later into earlier.

    A cluster's nearest is taken over both directions, by distance and then by the partner's order, so the pairs
    found are disjoint and all of them merge at once.
    """
    close = pairs.filter(F.col("distance") < similarity).select(*SCOPE, "a_ord", "b_ord", "distance")
    both = close.select(*SCOPE, F.explode(F.array(F.struct(F.col("a_ord").alias("ord"), F.col("b_ord").alias("partner")),
                                                  F.struct(F.col("b_ord").alias("ord"), F.col("a_ord").alias("partner")))).alias("s"), "distance")
    nearest = both.groupBy(*SCOPE, "s.ord").agg(F.min(F.struct("distance", "s.partner")).alias("_best")).select(
        *SCOPE, "ord", F.col("_best.partner").alias("partner")
    )
    other = nearest.select(*SCOPE, F.col("ord").alias("partner"), F.col("partner").alias("ord"))
    return nearest.join(other, [*SCOPE, "ord", "partner"]).filter("partner < ord").select(*SCOPE, "ord", F.col("partner").alias("unit"))


def _merge_mutual_rows(sums: np.ndarray, counts: np.ndarray, starts: np.ndarray, ends: np.ndarray, vicinity: int, similarity: float) -> np.ndarray:
    """Index of the unit each cluster ends up in, for one island in order of ``starts``.

    Close neighbours of every unit are kept with their distances. A merged unit keeps its index and start, so the
    ranges in which its neighbours lie are found by bisection; a round works out the neighbours of merged units only.
    """
    sums, counts, ends, alive = sums.copy(), counts.astype(np.int64), ends.copy(), np.ones(len(counts), bool)
    parent = np.arange(len(counts))
    near: list[dict[int, float]] = [{} for _ in parent]

    def meet(u: int, later_only: bool = False) -> None:
        low = u + 1 if later_only else int(np.searchsorted(starts, ends[u] - vicinity))
        others = np.arange(low, np.searchsorted(starts, starts[u] + vicinity, "right"))
        others = others[alive[others] & (others != u) & ((others < u) | (ends[others] - starts[u] <= vicinity))]
        away = sums[others] / counts[others, None] - sums[u] / counts[u]
        gaps = np.sqrt(np.einsum("ij,ij->i", away, away))
        for v, gap in zip(others[gaps < similarity].tolist(), gaps[gaps < similarity].tolist()):
            near[u][v] = near[v][u] = gap

    for u in range(len(parent)):
        meet(u, later_only=True)
    best = {u: min((gap, v) for v, gap in found.items())[1] for u, found in enumerate(near) if found}
    while True:
        pairs = [(u, v) for u, v in best.items() if u < v and best.get(v) == u]
        if not pairs:
            break
        for u, v in pairs:
            sums[u] += sums[v]
            counts[u] += counts[v]
            ends[u], alive[v], parent[v] = max(ends[u], ends[v]), False, u
        changed = {w for p in pairs for x in p for w in (x, *near[x])}
        for p in pairs:
            for x in p:
                for w in near[x]:
                    near[w].pop(x, None)
                near[x] = {}
        for u, _ in pairs:
            meet(u)
            changed.update(near[u])
        for u in changed:
            best.pop(u, None)
            if near[u]:
                best[u] = min((gap, v) for v, gap in near[u].items())[1]
    # Absorbed clusters name earlier ones, so one walk in order resolves every chain.
    for i in range(len(parent)):
        parent[i] = parent[parent[i]]
    return parent


def _mutual_rounds(summary: DataFrame, vicinity: int, similarity: float) -> DataFrame:
    """The same for islands of any size: one set of jobs a round, in which only pairs of merged units are new."""
    columns = ["ord", "n", "sum", "s_chn", "e_chn"]
    state = summary.select(*SCOPE, *columns)
    units = summary.select(*SCOPE, "ord", F.col("ord").cast("bigint").alias("unit"))
    rows, width = summary.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("sum")), F.lit(0))).first()
    row_bytes = 8 * width + 64
    crowd = summary.groupBy(*SCOPE, "s_chn").count().agg(F.max("count")).first()[0] or 0
    most = rows * min(rows, (vicinity + 1) * crowd)

    def close(earlier: DataFrame, later: DataFrame | None = None) -> DataFrame:
        found = vicinity_pairs(earlier, vicinity, later).select(*SCOPE, "a_ord", "b_ord", "distance")
        return pin(found, "_near", F.col("distance") < similarity).filter("_near").drop("_near")

    near = hold(close(state), most, 64)
    while True:  # a round with a pair leaves fewer clusters, so the rounds end
        joined = hold(mutual_partners(near, similarity), rows, 64)
        if joined.isEmpty():
            return units
        units = units.join(joined.select(*SCOPE, F.col("ord").alias("unit"), F.col("unit").alias("_to")), [*SCOPE, "unit"], "left")
        units = hold(units.select(*SCOPE, "ord", F.coalesce("_to", "unit").cast("bigint").alias("unit")), rows, 64)
        touched = joined.select(*SCOPE, F.explode(F.array("ord", "unit")).alias("ord"), "unit")
        still = state.join(touched.drop("unit"), [*SCOPE, "ord"], "left_anti")
        summed = state.join(touched, [*SCOPE, "ord"]).groupBy(*SCOPE, F.col("unit").alias("ord")).agg(
            F.sum("n").alias("n"), sum_by_position("sum", width).alias("sum"), F.min("s_chn").alias("s_chn"), F.max("e_chn").alias("e_chn")
        )
        merged = hold(summed, rows, row_bytes)
        state = hold(still.unionByName(merged.select(*SCOPE, *columns)), rows, row_bytes)
        end = lambda name: touched.select(*SCOPE, F.col("ord").alias(name))
        old = near.join(end("a_ord"), [*SCOPE, "a_ord"], "left_anti").join(end("b_ord"), [*SCOPE, "b_ord"], "left_anti")
        fresh = close(merged, state).unionByName(close(still, merged))
        near = hold(old.select(*SCOPE, "a_ord", "b_ord", "distance").unionByName(fresh), most, 64)


def merge_mutual(
    summary: DataFrame, vicinity: int = VICINITY, similarity: float = SIMILARITY, island_limit: int = MUTUAL_LIMIT
) -> DataFrame:
    """``recording, interval_id, ord, unit``: rounds of mutual nearest pairs until none is left.

    Independent of any order; the result differs from the greedy one by design. No pair spans two islands, so islands
    of at most ``island_limit`` clusters, counted first, run through all their rounds in the task that reads them.
    Larger ones go through rounds of joins, in which no group is gathered. Both keep the graph of close neighbours.
    """
    placed = materialize(islands(summary, vicinity).select(*SCOPE, "island", "ord", "n", "sum", "s_chn", "e_chn"))
    sizes = materialize(placed.groupBy(*SCOPE, "island").agg(F.count(F.lit(1)).alias("_n")))
    largest = sizes.agg(F.max("_n")).first()[0] or 0

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        cells = (rows[c].to_numpy() for c in ("n", "s_chn", "e_chn"))
        found = _merge_mutual_rows(np.stack(rows["sum"].to_numpy()), *cells, vicinity, similarity)
        ords = rows["ord"].to_numpy()
        return pd.DataFrame({c: rows[c].to_numpy() for c in SCOPE} | {"ord": ords, "unit": ords[found]})

    schema = f"recording string, interval_id int, ord {placed.schema['ord'].dataType.simpleString()}, unit bigint"
    at = [*SCOPE, "island"]
    if largest <= island_limit:
        return placed.groupBy(*at).applyInPandas(merge, schema)
    large = placed.join(sizes.filter(F.col("_n") > island_limit), at, "left_semi")
    small = placed.join(sizes.filter(F.col("_n") <= island_limit), at, "left_semi")
    return small.groupBy(*at).applyInPandas(merge, schema).unionByName(_mutual_rounds(large, vicinity, similarity))


def merge_clusters(summary: DataFrame, method: str = "mutual", **options) -> DataFrame:
    """Summary rows with ``unit``."""
    if method not in ("greedy", "mutual"):
        raise ValueError(f"unsupported merge method {method!r}")
    units = (merge_greedy if method == "greedy" else merge_mutual)(summary, **options)
    return summary.join(units, [*SCOPE, "ord"])


def unit_table(merged: DataFrame, minimal_support: float = MINIMAL_SUPPORT, dense: bool = False) -> DataFrame:
    """``recording, interval_id, unit, n, clusters, s_chn, e_chn, label, kept``.

    A unit is kept if it holds at least ``minimal_support`` of the interval's events, so at most 1 / support units
    are. ``label`` is its index among all units, with gaps where units are thrown; ``dense`` numbers kept ones only.
    """
    units = materialize(
        merged.groupBy(*SCOPE, "unit").agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("clusters"),
            F.min("s_chn").alias("s_chn"),
            F.max("e_chn").alias("e_chn"),
        )
    )
    totals = units.groupBy(*SCOPE).agg(F.sum("n").alias("_total"))
    judged = checked_join(units, totals, SCOPE, rows=units.count()).withColumn("kept", F.col("n") >= F.lit(minimal_support) * F.col("_total")).drop("_total")
    if not dense:
        return number_rows(judged, SCOPE, ["unit"], "label").withColumn("label", F.col("label").cast("int"))
    kept = number_rows(judged.filter("kept"), SCOPE, ["unit"], "label")
    return kept.unionByName(judged.filter("not kept").withColumn("label", F.lit(None).cast("bigint"))).withColumn(
        "label", F.col("label").cast("int")
    )


def label_events(assigned: DataFrame, merged: DataFrame, units: DataFrame) -> DataFrame:
    """Events with ``unit``, ``label`` and ``kept``: relabelling and support filter in one lookup per channel."""
    marks = F.map_from_entries(F.collect_list(F.struct("cluster", F.struct("unit", "label", "kept"))))
    per_channel = (
        merged.select(*KEYS, "cluster", "unit")
        .join(units.select(*SCOPE, "unit", "label", "kept"), [*SCOPE, "unit"])
        .groupBy(*KEYS)
        .agg(marks.alias("_marks"))
    )
    most = merged.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0
    marked = spread(assigned, KEYS).attach(per_channel, row_bytes=64 + 48 * most)
    return marked.withColumn("_m", F.element_at("_marks", F.col("cluster"))).select(*assigned.columns, "_m.unit", "_m.label", "_m.kept")


def robust_separation(
    assigned: DataFrame, pairs: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK, limit: int = DISTINCT_LIMIT
) -> DataFrame:
    """``a_ord, b_ord, separation``: distance of the coordinate-wise medians over the spread along their line.

    The spread is the root of the summed squared median absolute deviations of the members, projected on the
    difference of the medians. ``assigned`` carries ``ord``. Members are packed into chunk rows once; coordinates,
    projections on all lines of a cluster and their deviations are columns that exist inside a task only, and their
    medians are exact, by selection. A pair with a cluster that has no members is left out.
    """
    side = [*SCOPE, "ord"]
    members = spread(assigned.select(*side, "event_id", "x"), side)
    chunks = members.chunks(["x"], rows_per_chunk=rows_per_chunk).settle()
    centres = medians(chunks, ["event_ids", "x"], points_of, rows_per_chunk=rows_per_chunk, limit=limit)
    vectors = materialize(centres.withColumnRenamed("middle", "median"))
    end = lambda p: vectors.select(*SCOPE, F.col("ord").alias(f"{p}_ord"), F.col("median").alias(f"_{p}"))
    lines = pairs.select(*SCOPE, "a_ord", "b_ord").join(end("a"), [*SCOPE, "a_ord"]).join(end("b"), [*SCOPE, "b_ord"])
    lines = materialize(lines.select(*SCOPE, "a_ord", "b_ord", subtract(F.col("_a"), F.col("_b")).alias("line")))
    probes = lines.select(*SCOPE, F.explode(F.array("a_ord", "b_ord")).alias("ord"), F.struct("a_ord", "b_ord", "line").alias("_l"))
    per_ord = materialize(probes.groupBy(*side).agg(F.array_sort(F.collect_list("_l")).alias("_l")).select(*side, F.col("_l.a_ord"), F.col("_l.b_ord"), F.flatten("_l.line").alias("lines")))
    line_bytes = 64 + 8 * (per_ord.agg(F.max(F.size("lines") + 3 * F.size("a_ord"))).first()[0] or 0)

    def shadows(cells: dict[str, np.ndarray]) -> np.ndarray:
        x = points_of(cells)
        return x @ cells["lines"].reshape(-1, x.shape[1]).T

    def deviations(cells: dict[str, np.ndarray]) -> np.ndarray:
        return np.abs(shadows(cells) - cells["centre"])

    used = ["event_ids", "x", "lines"]
    centred = medians(chunks, used, shadows, per_ord.select(*side, "lines"), line_bytes, rows_per_chunk, limit)
    centred = materialize(per_ord.join(centred.withColumnRenamed("middle", "centre"), side))
    away = medians(chunks, [*used, "centre"], deviations, centred.select(*side, "lines", "centre"), line_bytes, rows_per_chunk, limit)
    mads = per_ord.join(away, side).select(*SCOPE, F.explode(F.arrays_zip("a_ord", "b_ord", "middle")).alias("_p"))
    mad = F.col("_p.middle")
    width = mads.groupBy(*SCOPE, "_p.a_ord", "_p.b_ord").agg(F.sqrt(F.sum(mad * mad)).alias("_width"))
    return lines.join(width, [*SCOPE, "a_ord", "b_ord"]).select(
        *SCOPE, "a_ord", "b_ord", F.try_divide(norm(F.col("line")), F.col("_width")).alias("separation")
    )
