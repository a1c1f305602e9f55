"""Result tables for people: a two-dimensional scatter and the run report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import uniform
from .merge import SCOPE
from .reduce import pca_features


def scatter_2d(labelled: DataFrame, fractions: dict[int, float] | None = None, seed: int = 1) -> DataFrame:
    """``keys…, event_id, label, px, py``: the two leading components of each interval, as a table for plotting.

    All events by default; ``fractions`` samples per label, by a hash of the event, so that a recomputed task takes the
    same ones. Labels that it does not name are left out.
    """
    if fractions:
        share = F.coalesce(*[F.when(F.col("label") == l, F.lit(float(f))) for l, f in fractions.items()], F.lit(0.0))
        labelled = labelled.filter(uniform(seed, 0, F.col("event_id"), F.col("channel")) < share)
    flat = pca_features(labelled, 2, basis="pooled", column="x", carry=("label",))
    return flat.withColumn("px", F.get("x", F.lit(0))).withColumn("py", F.get("x", F.lit(1))).drop("x")


def run_report(summary: DataFrame, units: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row per interval: events, clusters, units, kept units, kept, thrown and dropped events.

    Counts come from the summary tables. ``found`` (scope, ``found_events``, ``dropped_events``) has what detection
    found and what had no normalised waveform; without it, nothing was dropped.
    """
    clusters = summary.groupBy(*SCOPE).agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("clusters"))
    counted = units.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if("kept").alias("kept_units"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0)).alias("kept_events"),
        F.coalesce(F.sum(F.when(~F.col("kept"), F.col("n"))), F.lit(0)).alias("thrown_events"),
    )
    report = clusters.join(counted, SCOPE)
    if found is None:
        return report.withColumn("found_events", F.col("events")).withColumn("dropped_events", F.lit(0).cast("bigint"))
    whole = found.join(report, SCOPE, "left")
    zero = [c for c in report.columns if c not in SCOPE]
    return whole.fillna(0, zero).select(*report.columns, "found_events", "dropped_events")


def check_conservation(report: DataFrame) -> None:
    """Raise if kept, thrown and dropped events do not add up to the events found in some interval."""
    off = report.filter("kept_events + thrown_events <> events or events + dropped_events <> found_events").first()
    if off is not None:
        raise ValueError(f"events do not add up: {off.asDict()}")
