"""Result sinks."""

from __future__ import annotations

import json
import time

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    """Write a result table as Parquet or as a CSV copy; arrays become JSON text in CSV. Folders are created."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported sink format {fmt!r}")
    if fmt == "csv":
        nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
        df = df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])
    if partition_by:  # a few tasks per folder, so that neither files nor a large folder's task grow out of hand
        df = df.repartition(*partition_by, F.pmod(F.xxhash64(*[c for c, t in df.dtypes if t in ("bigint", "int")] or partition_by), F.lit(16)))
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).format(fmt).save(path)


COMMITS = "_commits"
INTERVAL = ("recording", "interval_id")


def commit_result(df: DataFrame, path: str, done: DataFrame | None = None, by: tuple[str, ...] = INTERVAL) -> None:
    """Write the rows of whole intervals under ``path``; a repeated run replaces its own intervals and no others.

    Every interval is a folder of its own, so recordings never share one. Folders of the intervals in ``df`` are
    overwritten, then a row for each goes to the manifest, in one commit. Readers see an interval once its row is
    there, so a run that was cut off shows as intervals to do again (``pending``), not as part of a result. ``done``
    names all intervals of the run: those that have no rows are committed as empty and hide what an earlier run left.
    ``df`` is read twice and should be written.
    """
    by = list(by)
    df.repartition(*by, F.pmod(F.xxhash64(*[c for c, t in df.dtypes if t in ("bigint", "int")] or by), F.lit(16))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*by).parquet(f"{path}/data")
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    if done is not None:
        counts = done.select(*by).distinct().join(counts, by, "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
    stamped = counts.select(*by, "rows", F.lit(time.time_ns()).alias("committed"), F.lit(df.schema.json()).alias("schema"))
    stamped.coalesce(1).write.mode("append").parquet(f"{path}/{COMMITS}")


def committed(spark: SparkSession, path: str, by: tuple[str, ...] = INTERVAL) -> DataFrame:
    """``by…, rows, committed, schema``: the last commit of each interval; none if nothing was committed."""
    try:
        rows = spark.read.parquet(f"{path}/{COMMITS}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        kinds = ", ".join(f"{c} {'int' if c == 'interval_id' else 'string'}" for c in by)
        return spark.createDataFrame([], f"{kinds}, rows bigint, committed bigint, schema string")
    last = F.max(F.struct("committed", "rows", "schema")).alias("_c")
    return rows.groupBy(*by).agg(last).select(*by, "_c.rows", "_c.committed", "_c.schema")


def pending(wanted: DataFrame, path: str, by: tuple[str, ...] = INTERVAL) -> DataFrame:
    """Intervals of ``wanted`` that no run has committed yet: what a restarted job has left to do."""
    return wanted.select(*by).distinct().join(committed(wanted.sparkSession, path, by), list(by), "left_anti")


def read_result(spark: SparkSession, path: str, by: tuple[str, ...] = INTERVAL) -> DataFrame:
    """The rows of all committed intervals, with the types they were written with."""
    commits = committed(spark, path, by)
    schema = commits.agg(F.max(F.struct("committed", "schema"))["schema"]).first()[0]
    if schema is None:
        raise ValueError(f"nothing is committed under {path}")
    full = commits.filter("rows > 0").select(*by)
    if full.isEmpty():
        return spark.createDataFrame([], T.StructType.fromJson(json.loads(schema)))
    rows = spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{path}/data")
    return rows.join(full, list(by), "left_semi").select(*T.StructType.fromJson(json.loads(schema)).names)


def write_recording(frames: DataFrame, path: str, by: str, order: list[str], channels: list[str]) -> DataFrame:
    """Write one interleaved int16 file per value of ``by`` under ``path``, frames in ``order``; lazy.

    Returns ``by`` and ``frames`` of each file. Values are rounded and have to fit 16 bits. A file is written by one
    task as a whole and overwritten when the task is tried again, so a file should hold a bounded recording.
    """

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        data = np.rint(rows.sort_values(order)[channels].to_numpy())
        if len(data) and (data.min() < -32768 or data.max() > 32767):
            raise ValueError("a value does not fit 16 bits")
        target = f"{path}/{rows[by].iloc[0]}.bin"
        filesystem, inner = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)
        filesystem.create_dir(inner.rpartition("/")[0], recursive=True)
        with filesystem.open_output_stream(inner) as stream:
            stream.write(data.astype("<i2").tobytes())
        return pd.DataFrame({by: rows[by].iloc[:1], "frames": [len(rows)]})

    kind = frames.schema[by].dataType.simpleString()
    return frames.select(*dict.fromkeys([by, *order, *channels])).groupBy(by).applyInPandas(write, f"{by} {kind}, frames bigint")
