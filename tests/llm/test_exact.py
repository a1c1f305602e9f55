from pyspark.sql import functions as F

from pulsegrid.llm import exact as X
from pulsegrid.llm.common import scratch

ROWS = [(1, "a"), (5, "a"), (3, "a"), (2, "b"), (4, None), (6, ""), (None, "c"), (8, "c"), (9, "long " * 50_000), (10, "long " * 50_000), (7, "a ")]


def groups(docs, **how):
    found = X.exact_groups(docs, **how)
    rows = X.arrival(docs).select("doc_id", "_k1", "_k2").join(found, ["_k1", "_k2"])
    return sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in rows.collect())


WANT = [(0, 8, 2), (1, 5, 3), (2, 2, 1), (3, 5, 3), (4, 6, 2), (5, 5, 3), (6, 6, 2), (7, 7, 1), (8, 8, 2), (9, 10, 2), (10, 10, 2)]


def test_largest_id_of_equal_texts_stays(documents, clashing):
    docs = clashing(documents(ROWS))
    assert groups(docs) == WANT
    kept = X.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7, 8, 10]


def test_equal_digests_of_different_texts_are_told_apart(documents):
    """A digest of one bit: nearly every hit is a collision, and full bytes decide."""
    assert groups(documents(ROWS), digest=lambda t: F.substring(F.sha2(t, 256), 1, 1).isin(*"01234567").cast("string")) == WANT
    assert groups(documents(ROWS), digest=lambda t: F.lit("same")) == WANT


def test_state_goes_on_where_it_stopped(spark, documents):
    folder = scratch(spark, "test")
    schema = "digest string, doc_id bigint, _k1 bigint, _k2 bigint"
    states = []
    for rows in ([(1, "a"), (2, "b")], [(3, "a")], []):
        X.arrival(documents(rows)).write.mode("append").parquet(f"{folder}/rows")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/rows")
        states.append(sorted((r.keep_id, r.group_size) for r in X.dedup_stream(stream, f"{folder}/stream").collect()))
    assert states == [[(1, 1), (2, 1)], [(2, 1), (3, 2)], [(2, 1), (3, 2)]]


def test_repeated_rows_and_empty_table(documents):
    docs = documents([(1, "a"), (1, "a"), (None, None), (None, None)])
    assert groups(docs) == [(0, None, 2), (0, None, 2), (1, 1, 2), (1, 1, 2)]
    assert sorted((r.doc_id or 0) for r in X.drop_copies(docs).collect()) == [0, 1]
    assert X.drop_copies(documents([])).count() == 0
