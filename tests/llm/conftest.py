import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(*r, *[None, "s"][len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in full], SCHEMA)

    return make


CLASHING = ["_k1", "_k2", "_row", "digest", "keep_id", "n", "rep", "tokens", "packed", "ids", "exact", "pass", "block", "n_lines", "kept_text", "_at", "rejected"]


@pytest.fixture
def clashing():
    """Adds columns with names that the operators use themselves."""
    from pyspark.sql import functions as F

    return lambda docs: docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
