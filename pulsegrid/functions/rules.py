"""Small scalar rules and seeded draws."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the workload.
SAMPLE_HZ = 30000
LOW_HZ = 300.0
HIGH_HZ = 6000.0
FILTER_ORDER = 2
MIN_CLUSTERS = 3
MAX_CLUSTERS = 10
EVENTS_PER_CLUSTER = 100
VICINITY = 8
SIMILARITY = 2.0
MERGE_PASSES = 8
MINIMAL_SUPPORT = 0.005


def cluster_count(n: Column) -> Column:
    """Number of clusters for ``n`` events: one per hundred, at least 3 and at most 10."""
    wanted = F.ceil(n / F.lit(EVENTS_PER_CLUSTER)).cast("int")
    return F.least(F.lit(MAX_CLUSTERS), F.greatest(F.lit(MIN_CLUSTERS), wanted))


def uniform(seed: int, step: int, *ids: Column) -> Column:
    """A reproducible draw in (0, 1) from the first 52 bits of an md5; any SQL engine can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), *[c.cast("string") for c in ids])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def uniforms(seed: int, step: int, ids, *more: int) -> np.ndarray:
    """The draws of ``uniform`` for integer ids, followed by ``more``, inside tasks."""
    end = b"".join(b":%d" % m for m in more)
    bits = [int(hashlib.md5(b"%d:%d:%d%b" % (seed, step, i, end)).hexdigest()[:13], 16) for i in ids]
    return (np.array(bits, dtype=np.float64) + 0.5) / 2.0**52
