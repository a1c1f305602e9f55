"""Spark data source ``recording``: headerless files of int16 frames, channels interleaved.

    spark.dataSource.register(RecordingSource)
    spark.read.format("recording").option("channels", 384).option("lead", 926).option("tail", 202).load(path)

A row is one channel's block with neighbours (see ``series``), so filter and detection need no shuffle. Tasks read
disjoint frame ranges with only the few neighbouring frames twice. Paths go through ``pyarrow.fs`` and may be a file,
a directory or a comma-separated list, on any file system that it knows (``file``, ``hdfs``, ``s3``, ``gs``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..functions.rules import SAMPLE_HZ

SCHEMA = (
    "recording string, interval_id int, channel int, block bigint, start bigint, n_core int, first bigint, "
    "samples array<smallint>"
)
# Fixed values of the workload.
CHANNELS = 384
INTERVAL_SECONDS = 3

BLOCK_LIMIT = 131_072  # samples; an interval up to this length is one block
PARTITION_BYTES = 128 * 1024 * 1024
BATCH_SAMPLES = 4_000_000  # samples per Arrow batch


@dataclass
class FrameRange:
    path: str
    interval_id: int
    origin: int  # first frame of the interval in the file
    frames: int  # frames of the interval
    first_block: int
    last_block: int  # exclusive
    first_channel: int
    last_channel: int  # exclusive
    bytes: int


@dataclass
class ScanTask(InputPartition):
    ranges: list[FrameRange]


def pack_ranges(ranges: list[FrameRange], limit: int) -> list[ScanTask]:
    """Neighbouring ranges in one task while they stay within ``limit`` bytes; small files do not become small tasks."""
    tasks: list[ScanTask] = []
    held = limit + 1
    for r in ranges:
        if held + r.bytes > limit:
            tasks.append(ScanTask([]))
            held = 0
        tasks[-1].ranges.append(r)
        held += r.bytes
    return tasks


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of every recording file behind ``path``; a missing one is an error."""
    found = []
    for item in filter(None, (p.strip() for p in path.split(","))):
        filesystem, inner = fs.FileSystem.from_uri(item) if "://" in item else (fs.LocalFileSystem(), item)
        info = filesystem.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no recording at {item}")
        if info.type == fs.FileType.File:
            found.append((item, info.size))
            continue
        prefix = item.split("://")[0] + "://" if "://" in item else ""
        inside = filesystem.get_file_info(fs.FileSelector(inner, recursive=True))
        found += [(prefix + f.path, f.size) for f in inside if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    if not found:
        raise FileNotFoundError(f"no recording at {path}")
    return sorted(found)


class RecordingSource(DataSource):
    """Options: ``channels``, ``sample_hz``, ``interval_s``, ``block_len``, ``lead``, ``tail``, ``max_frames``,
    ``partition_bytes``, ``channel_groups`` (tasks per frame range, each for some channels; the range is read by each
    of them, so this is for recordings with fewer ranges than cores), ``min_tasks`` (ranges are packed up to
    ``partition_bytes`` only while this many tasks remain), ``intervals`` (``first-last`` or ``first-``: skips the bytes
    of others), ``only_channels`` (numbers with commas: makes rows of these only), ``pushdown``."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        pushdown = self.options.get("pushdown", "false").lower() == "true"
        return (FilteringReader if pushdown else RecordingReader)(self.options)


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        number = lambda name, default: int(float(options.get(name, default)))
        self.path = options.get("path", "")
        self.channels = number("channels", CHANNELS)
        self.interval = number("interval_s", INTERVAL_SECONDS) * number("sample_hz", SAMPLE_HZ)
        self.block_len = number("block_len", min(self.interval, BLOCK_LIMIT))
        self.lead = number("lead", 0)
        self.tail = number("tail", 0)
        self.max_frames = number("max_frames", 0)
        self.partition_bytes = number("partition_bytes", PARTITION_BYTES)
        self.channel_groups = min(number("channel_groups", 1), self.channels)
        self.min_tasks = max(number("min_tasks", 1), 1)
        first, _, last = options.get("intervals", "0-").partition("-")
        self.wanted_intervals = (int(first), int(last) if last else None)
        chosen = options.get("only_channels", "")
        self.wanted_channels: set[int] | None = {int(c) for c in chosen.split(",")} if chosen else None
        if min(self.channels, self.interval, self.block_len) < 1:
            raise ValueError("channels, interval and block_len must be positive")

    def partitions(self) -> list[ScanTask]:
        frame_bytes = 2 * self.channels
        blocks_per_task = max(1, self.partition_bytes // (frame_bytes * self.block_len))
        low, high = self.wanted_intervals
        edges = np.linspace(0, self.channels, self.channel_groups + 1).astype(int).tolist()
        ranges = []
        for path, size in list_files(self.path):
            if size % frame_bytes:
                raise ValueError(f"{path}: {size} bytes is not a whole number of {self.channels}-channel frames")
            total = size // frame_bytes
            if self.max_frames:
                total = min(total, self.max_frames)
            last = -(-total // self.interval) - 1
            for interval_id in range(low, (last if high is None else min(last, high)) + 1):
                origin = interval_id * self.interval
                frames = min(self.interval, total - origin)
                blocks = -(-frames // self.block_len)
                for at in range(0, blocks, blocks_per_task):
                    end = min(at + blocks_per_task, blocks)
                    size_read = (min(end * self.block_len, frames) - at * self.block_len) * frame_bytes
                    groups = zip(edges, edges[1:])
                    ranges += [FrameRange(path, interval_id, origin, frames, at, end, *g, size_read) for g in groups]
        share = sum(r.bytes for r in ranges) // self.min_tasks
        # Spark wants at least one partition.
        return pack_ranges(ranges, min(self.partition_bytes, share)) or [ScanTask([])]

    def read(self, task: ScanTask) -> Iterator[pa.RecordBatch]:
        for part in task.ranges:
            yield from self._read_range(part)

    def _read_range(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        local = "://" not in part.path
        filesystem, inner = (fs.LocalFileSystem(), part.path) if local else fs.FileSystem.from_uri(part.path)
        wanted = np.arange(part.first_channel, part.last_channel, dtype=np.int32)
        if self.wanted_channels is not None:
            wanted = wanted[np.isin(wanted, sorted(self.wanted_channels))]
        if not len(wanted):
            return
        width = 2 * self.channels
        with filesystem.open_input_file(inner) as handle:
            for block in range(part.first_block, part.last_block):
                start = block * self.block_len
                stop = min(start + self.block_len, part.frames)
                first, end = max(start - self.lead, 0), min(stop + self.tail, part.frames)
                raw = handle.read_at((end - first) * width, (part.origin + first) * width)
                frames = np.frombuffer(raw, dtype="<i2").reshape(-1, self.channels)
                step = max(1, BATCH_SAMPLES // len(frames))
                for at in range(0, len(wanted), step):
                    some = wanted[at : at + step]
                    lines = np.ascontiguousarray(frames[:, some].T)
                    yield self._batch(part, block, start, stop - start, first, some, lines)

    @staticmethod
    def _batch(part, block, start, n_core, first, channels, lines) -> pa.RecordBatch:
        rows, length = lines.shape
        offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * length)
        same = lambda value, kind: pa.array([value] * rows, kind)
        columns = {
            "recording": same(part.path, pa.string()),
            "interval_id": same(part.interval_id, pa.int32()),
            "channel": pa.array(channels),
            "block": same(block, pa.int64()),
            "start": same(start, pa.int64()),
            "n_core": same(n_core, pa.int32()),
            "first": same(first, pa.int64()),
            "samples": pa.ListArray.from_arrays(offsets, pa.array(lines.reshape(-1))),
        }
        return pa.RecordBatch.from_pydict(columns)


class FilteringReader(RecordingReader):
    """The reader for sessions with ``spark.sql.python.filterPushdown.enabled``; Spark refuses it in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take comparisons on ``interval_id`` (skips byte ranges) and equality on ``channel`` (skips rows)."""
        low, high = self.wanted_intervals
        for f in filters:
            match f:
                case EqualTo(("interval_id",), v):
                    low, high = max(low, v), v if high is None else min(high, v)
                case GreaterThan(("interval_id",), v):
                    low = max(low, v + 1)
                case GreaterThanOrEqual(("interval_id",), v):
                    low = max(low, v)
                case LessThan(("interval_id",), v):
                    high = v - 1 if high is None else min(high, v - 1)
                case LessThanOrEqual(("interval_id",), v):
                    high = v if high is None else min(high, v)
                case EqualTo(("channel",), v):
                    self.wanted_channels = {v} if self.wanted_channels is None else self.wanted_channels & {v}
                case In(("channel",), values):
                    wanted = set(values)
                    self.wanted_channels = wanted if self.wanted_channels is None else self.wanted_channels & wanted
                case _:
                    yield f
        self.wanted_intervals = (low, high)


def frame_ranges(path: str, channels: int, interval_frames: int) -> int:
    """Number of interval pieces in the files, the natural number of tasks for whole-interval blocks."""
    return sum(-(-size // (2 * channels * interval_frames)) for _, size in list_files(path))


def read_recording(spark: SparkSession, path: str, **options) -> DataFrame:
    """Blocks of an interleaved int16 recording; see the module text for the options."""
    spark.dataSource.register(RecordingSource)
    list_files(path)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("recording").option("pushdown", pushdown)
    reader = reader.option("min_tasks", str(spark.sparkContext.defaultParallelism))
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load(path)
