"""The whole job: recording or blocks in, labelled events, units, classifier and report out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import HIGH_HZ, LOW_HZ, MINIMAL_SUPPORT, SAMPLE_HZ, SIMILARITY
from ..operators import detect
from ..operators.bandpass import bandpass, bandpass_joined, warm_up
from ..operators.cluster import cluster_events, cluster_summary
from ..operators.merge import SCOPE, label_events, merge_clusters, unit_table
from ..operators.reduce import COMPONENTS, extract_features
from ..operators.report import check_conservation, run_report
from ..operators.svm import fit_svm, library_svm, predict
from ..plans.spread import materialize, stage
from ..session import KEYS
from ..sources.recording import BLOCK_LIMIT, CHANNELS, INTERVAL_SECONDS, frame_ranges, list_files, read_recording
from ..sources.sinks import commit_result, committed, write_result


@dataclass(frozen=True)
class Sorted:
    """Results of a run. ``labelled`` holds the kept events; ``assigned`` all of them."""

    assigned: DataFrame
    summary: DataFrame
    unit_map: DataFrame
    units: DataFrame
    labelled: DataFrame
    weights: DataFrame | None
    report: DataFrame
    width: int = field(default=COMPONENTS)

    def predict(self, samples: DataFrame) -> DataFrame:
        return predict(samples, self.weights, width=self.width)

    def write(self, path: str, mode: str = "error", text_copy: bool = False) -> None:
        """Labelled events, unit map, units, weights and report under ``path``, each interval committed on its own.

        ``mode``: ``error`` refuses a folder in which one of the run's intervals is committed; ``overwrite`` replaces
        these intervals and leaves all others, so a run that was cut off can be started again into the same folder.
        """
        intervals = materialize(self.report.select(*SCOPE).distinct())
        if mode not in ("error", "overwrite"):
            raise ValueError(f"unsupported mode {mode!r}")
        tables = {"labelled": self.labelled, "unit_map": self.unit_map, "units": self.units, "weights": self.weights, "report": self.report}
        tables = {name: table for name, table in tables.items() if table is not None}
        if mode == "error":
            for name in tables:
                if not intervals.join(committed(intervals.sparkSession, f"{path}/{name}"), SCOPE, "left_semi").isEmpty():
                    raise ValueError(f"intervals of this run are already committed under {path}/{name}; use mode='overwrite'")
        for name, table in tables.items():
            commit_result(table, f"{path}/{name}", intervals)
        if text_copy:
            write_result(self.labelled, f"{path}/labelled_csv", "csv", mode)


def sort_blocks(
    blocks: DataFrame,
    *,
    window: int = detect.WINDOW,
    factor: float = detect.FACTOR,
    offset: int = detect.OFFSET,
    max_threshold: float = detect.MAX_THRESHOLD,
    whole: bool = False,
    features: str = "pca",
    basis: str = "channel",
    components: int = COMPONENTS,
    cluster: str = "km",
    merge: str = "mutual",
    similarity: float = SIMILARITY,
    minimal_support: float = MINIMAL_SUPPORT,
    svm: str | None = "BGD",
    max_steps: int | None = None,
    seed: int = 1,
) -> Sorted:
    """From filtered blocks (``y``) to units and classifier.

    Events, features, assignments and labels are each written once as columns to the checkpoint folder, small tables
    as rows, since later steps read them several times. ``svm``: ``BGD``, ``MBGD``, ``SGD``, ``library`` (for one interval) or None for no
    classifier; ``max_steps`` None goes on until every class has met its stop rule.
    """
    events = detect.detect_events(blocks, window, factor, offset, max_threshold, whole=whole, min_events=2)
    found = stage(detect.normalise_all(events).select(*KEYS, "event_id", "wave"))
    waves = found.filter("wave is not null")
    width = min(components, 2 * window)
    extra = {"basis": basis} if features.lower() == "pca" else {}
    reduced = stage(extract_features(waves, features, width, **extra))
    assigned = stage(cluster_events(reduced, cluster, width, seed=seed))
    summary = materialize(cluster_summary(assigned, width))
    unit_map = materialize(merge_clusters(summary, merge, similarity=similarity))
    units = materialize(unit_table(unit_map, minimal_support))
    labelled = stage(label_events(assigned, unit_map, units).filter("kept").drop("kept"))
    weights = _train(labelled, svm, width, max_steps, seed)
    counts = found.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("found_events"), F.count_if(F.col("wave").isNull()).alias("dropped_events"))
    report = run_report(summary, units, counts)
    check_conservation(report)
    return Sorted(assigned, summary, unit_map, units, labelled, weights, report, width)


def _train(labelled: DataFrame, svm: str | None, width: int, max_steps: int | None, seed: int) -> DataFrame | None:
    if svm is None:
        return None
    if svm != "library":
        return fit_svm(labelled, svm, width, max_steps=max_steps, seed=seed)
    scope = labelled.select(*SCOPE).head(1)
    models = library_svm(labelled)
    return models.select(*[F.lit(scope[0][c] if scope else None).alias(c) for c in SCOPE], "*")


def sort_recording(
    spark: SparkSession,
    path: str,
    *,
    channels: int = CHANNELS,
    interval_s: int = INTERVAL_SECONDS,
    sample_hz: int = SAMPLE_HZ,
    low: float = LOW_HZ,
    high: float = HIGH_HZ,
    block_len: int | None = None,
    first_interval_only: bool = False,
    output: str | None = None,
    window: int = detect.WINDOW,
    offset: int = detect.OFFSET,
    **options,
) -> Sorted:
    """Sort an interleaved int16 recording; every interval is sorted on its own.

    An interval of up to ``BLOCK_LIMIT`` samples is one block per channel: scan, filter, threshold and detection
    then form one stage without a shuffle. Longer intervals are cut into blocks with neighbours; if the band is so
    narrow that a block would need more samples to warm up on than it has, states are joined across blocks instead.
    """
    interval = interval_s * sample_hz
    options.setdefault("merge", "greedy")  # the device bounds the channels of an interval
    length = block_len or min(interval, BLOCK_LIMIT)
    lead = detect.lead_needed(window, offset)
    settle = warm_up(low, high, sample_hz)
    joined = length < interval and settle > length  # a narrow band: states are joined, samples would be too many
    # Of a folder, the first interval of every file.
    ranges = len(list_files(path)) if first_interval_only else frame_ranges(path, channels, interval)
    cores = spark.sparkContext.defaultParallelism
    blocks = read_recording(
        spark,
        path,
        channels=channels,
        sample_hz=sample_hz,
        interval_s=interval_s,
        block_len=length,
        lead=lead if joined else settle + lead,
        tail=detect.tail_needed(window, offset),
        channel_groups=max(1, cores // max(ranges, 1)) if length >= interval else 1,
        **({"max_frames": interval} if first_interval_only else {}),
    )
    if joined:
        filtered = bandpass_joined(blocks, low, high, sample_hz, lead=lead)
    else:
        filtered = bandpass(blocks, low, high, sample_hz, keep_lead=lead)
    if length < interval:  # thresholds need one column of it, detection the others: the recording is read once
        filtered = stage(filtered)
    result = sort_blocks(filtered, window=window, offset=offset, whole=length >= interval, **options)
    if output:
        result.write(output)
    return result


def event_times(events: DataFrame, sample_hz: float = SAMPLE_HZ) -> DataFrame:
    """Events with ``seconds`` from the start of their interval."""
    return events.withColumn("seconds", F.col("event_id") / F.lit(float(sample_hz)))
