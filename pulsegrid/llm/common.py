"""Helpers shared by the text operators: row identity, expressions, and joins that no hot key can slow down."""

from __future__ import annotations

import ctypes
import math
import uuid
from contextlib import suppress

import numpy as np
import pyarrow as pa
import zstandard
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spread import materialize
from ..session import checkpoint_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = " \t\n\x0b\x0c\r"
MAX_HOT_KEYS = 5_000
MIN_HOT_ROWS = 1_000
ROWS_PER_TASK = 100_000
SLICE_ROWS = 512
#: For the JVM of a driver: the percentage of its heap that stays free after a collection at most, and the milliseconds without
#: one after which it collects by itself.
DRIVER_FLAGS = {"MaxHeapFreeRatio": "50", "G1PeriodicGCInterval": "5000"}


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def row_key(*columns: Column) -> list[Column]:
    """128 hash bits that name a row by its content: equal rows share them, and nulls need no care in joins."""
    return [F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit("second"), *columns).alias("_k2")]


def whole_rows(docs: DataFrame, *named_by: str) -> DataFrame:
    """``_row``, a struct of all columns whatever their names, with the key of ``named_by`` and the text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, *row_key(*map(F.col, named_by), whole_text()))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` agrees on texts of ASCII alone, and is faster there."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def tiered_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row per key and the number of rows that have the key.

    Keys of more than 1/5000 of all rows are at most 5,000, so they are broadcast whatever the input; their rows never
    meet in one task. All other keys are joined by a shuffle in which no key can be large. ``rows`` is read twice and
    should be written; ``keyed`` has to be written.
    """
    total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    limit = max(MIN_HOT_ROWS, math.ceil(total / MAX_HOT_KEYS))
    hot = F.broadcast(keyed.filter(F.col(weight) >= limit))
    cold = keyed.filter(F.col(weight) < limit)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(cold.hint("shuffle_merge"), on))


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """No more tasks than ``rows`` narrow rows need, and no fewer than there are cores."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))


def slices(batches, rows: int = SLICE_ROWS):
    """Arrow batches in pieces of at most ``rows`` rows, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def compress_text(batches):
    """For ``mapInArrow``: the last column, binary ``text``, becomes ``packed``; the columns before it stay.

    Prose shrinks much more as whole documents than in a shuffle's small blocks.
    """
    packer = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches):
        packed = pa.array([packer.compress(x or b"") for x in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], [*batch.schema.names[:-1], "packed"])


def unpack_text(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def give_back(spark: SparkSession | None = None) -> None:
    """Returns memory that this process has freed to the machine, where the C library can; a driver lives long.

    With ``spark``, its JVM collects its garbage too: many small jobs in a row leave plans behind, and the heap would grow
    to its limit before it is asked to. Spark then removes the shuffles and checkpoints that nothing refers to any more.
    What the JVM's compiler and its many threads have freed outside the heap goes back as well, where the JVM has the command.
    A job of thousands of tasks leaves as much while it runs, so from then on the JVM also collects by itself.
    """
    if spark is not None:
        for name, value in DRIVER_FLAGS.items():
            with suppress(Py4JJavaError):
                set_flag(spark, name, value)
        spark.sparkContext._jvm.System.gc()
        with suppress(Py4JJavaError):
            diagnose(spark, "systemTrimNativeHeap")
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def diagnose(spark: SparkSession, command: str):
    """What a diagnostic command of the driver's JVM says; an error where it has no such command."""
    return _command(spark, command)


def set_flag(spark: SparkSession, name: str, value: str):
    """Sets a flag that a running JVM takes; returns what the driver's JVM says about one that it does not take."""
    return _command(spark, "vmSetFlag", name, value)


def _command(spark: SparkSession, command: str, *words: str):
    """The bean server's class is not open to callers, so its method is taken from the public interface."""
    jvm = spark.sparkContext._jvm
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    array = spark.sparkContext._gateway.new_array
    given = array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), command
    if words:
        said, given[2], given[3] = array(jvm.String, len(words)), array(jvm.java.lang.Object, 1), array(jvm.String, 1)
        for i, word in enumerate(words):
            said[i] = word
        given[2][0], given[3][0] = said, "[Ljava.lang.String;"
    return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, which all executors reach."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


__all__ = [
    "SPACE",
    "UPPER",
    "ascii_lower",
    "compress_text",
    "fitted",
    "give_back",
    "let",
    "materialize",
    "read_documents",
    "row_key",
    "scratch",
    "slices",
    "tiered_join",
    "unpack_text",
    "whole_rows",
    "whole_text",
]
