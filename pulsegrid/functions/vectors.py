"""Vector arithmetic on ``ARRAY<DOUBLE>`` columns, all JVM-side."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p - q)


def scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda p: p * factor)


def squared_difference(a: Column, b: Column) -> Column:
    """Element-wise squared difference."""
    return F.zip_with(a, b, lambda p, q: (p - q) * (p - q))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(ZERO), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def squared_distance(a: Column, b: Column) -> Column:
    return total(squared_difference(a, b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sum_by_position(column: str, width: int) -> Column:
    """Aggregate: element-wise sum of a vector column of known width, as ``width`` plain sums.

    Plain sums keep Spark's hash aggregation with partial sums, so one row per (task, group) is shuffled.
    """
    return F.expr("array(" + ", ".join(f"sum(get({column}, {i}))" for i in range(width)) + ")")


def sum_vectors(x: Column) -> Column:
    """Aggregate: element-wise sum of a vector column of any (long) width, with partial aggregation."""
    return vector_to_array(Summarizer.sum(array_to_vector(x)))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")
