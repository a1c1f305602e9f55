"""Exact dedup as a stateful stream: one state row per digest, on disk and without expiry, and a check of full bytes."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize, read_documents, row_key, scratch, tiered_join, whole_rows, whole_text

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PER_TRIGGER = 64
HITS_PER_SALT = 1_000


@contextmanager
def _settings(spark: SparkSession):
    """State stores of queries that start inside are RocksDB: state lives on disk, changes in the checkpoint folder.

    A store is closed when its task ends, so a machine holds the files of the stores in use only.
    """
    values = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    }
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def sha_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def arrival(docs: DataFrame, digest=sha_digest) -> DataFrame:
    """What the state needs of each row of a table or stream: digest, identifier and content locator (a row key)."""
    text = whole_text()
    return docs.select(digest(text).alias("digest"), "doc_id", *row_key(F.col("doc_id"), text))


def dedup_stream(arrivals: DataFrame, folder: str) -> DataFrame:
    """Run the stream to the end of what has arrived and return the state.

    ``arrivals`` is a streaming DataFrame from ``arrival``. The state keeps, per digest, the number of rows and the
    identifier and locator of the row to keep: the largest doc_id, then the largest locator. It has no watermark, so
    nothing expires; running again with the same ``folder`` goes on from the rows already seen. Each task first
    combines its own rows of a digest, so a digest that a third of all rows share sends one row per task.

    Returns ``digest``, ``group_size``, ``keep_id``, ``keep_1``, ``keep_2``.
    """
    spark = arrivals.sparkSession
    state = arrivals.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "_k1", "_k2")).alias("keep")
    )
    with _settings(spark):
        query = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", folder)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    if query.lastProgress is None and not query.recentProgress:
        schema = "digest string, group_size bigint, keep_id bigint, keep_1 bigint, keep_2 bigint"
        return spark.createDataFrame([], schema)
    stored = spark.read.format("statestore").load(folder)
    n, keep = stored.schema["value"].dataType.names
    value = F.col("value")
    return stored.select(
        F.col("key.digest").alias("digest"),
        value[n].alias("group_size"),
        value[keep]["doc_id"].alias("keep_id"),
        value[keep]["_k1"].alias("keep_1"),
        value[keep]["_k2"].alias("keep_2"),
    )


def _compare(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` with ``same``: whether the row's bytes equal those of the row to keep. Moves the texts of hits only.

    A kept text that many rows are compared with is sent in several salts, one per 1,000 of its rows.
    """
    salts = F.ceil(F.col("group_size") / HITS_PER_SALT)
    wanted = hits.groupBy("keep_1", "keep_2").agg(F.max(salts).alias("_salts"))
    texts = docs.select(*row_key(F.col("doc_id"), whole_text()), whole_text().alias("_text"))
    kept = (
        wanted.join(texts.dropDuplicates(["_k1", "_k2"]).hint("shuffle_merge"), (F.col("keep_1") == F.col("_k1")) & (F.col("keep_2") == F.col("_k2")))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)))
        .select("keep_1", "keep_2", "_salt", F.col("_text").alias("_kept"))
    )
    mine = hits.join(texts.dropDuplicates(["_k1", "_k2"]).hint("shuffle_merge"), ["_k1", "_k2"]).withColumn("_salt", F.pmod("_k1", salts))
    same = F.col("_text") == F.col("_kept")
    return mine.join(kept.hint("shuffle_merge"), ["keep_1", "keep_2", "_salt"]).withColumn("same", same).drop("_text", "_kept", "_salt")


def resolve(docs: DataFrame, state: DataFrame, digest=sha_digest) -> DataFrame:
    """One row per different (doc_id, text) of ``docs``: locator, digest, keep_id, keep locator, group_size.

    Every row whose digest the state holds for another row is a hit, and its full bytes are compared with the row to
    keep. Rows that differ although their digests agree form a group of their own with the same rules, again and
    again until no row differs.
    """
    keep = ["keep_id", "keep_1", "keep_2", "group_size"]
    rows = arrival(docs, digest).groupBy("digest", "_k1", "_k2").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_n"))
    rows = materialize(rows)
    state = materialize(state)
    alone = state.filter("group_size = 1").select("digest", *keep)
    several = materialize(state.filter("group_size > 1"))
    single = rows.join(alone.hint("shuffle_merge"), "digest", "left_semi").select(
        "_k1", "_k2", "digest", F.col("doc_id").alias("keep_id"), F.col("_k1").alias("keep_1"), F.col("_k2").alias("keep_2"), F.lit(1).cast("bigint").alias("group_size")
    )
    done, todo = single, several
    open_rows = rows
    names = ["_k1", "_k2", "digest", *keep]
    while True:
        hits = materialize(tiered_join(open_rows, todo, ["digest"], "group_size"))
        other = ~((F.col("_k1") == F.col("keep_1")) & (F.col("_k2") == F.col("keep_2")))
        checked = materialize(_compare(docs, hits.filter(other)).select("_k1", "_k2", "digest", "doc_id", "_n", *keep, "same"))
        differ = checked.filter(~F.col("same"))
        give_back(docs.sparkSession)
        if differ.isEmpty():
            return done.unionByName(hits.select(*names))
        # A digest with different texts: those equal to the kept row are settled, the others start anew.
        less = differ.groupBy("digest").agg(F.sum("_n").alias("_less"))
        right = hits.join(differ.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti").join(less, "digest", "left")
        done = materialize(
            done.unionByName(right.withColumn("group_size", F.col("group_size") - F.coalesce("_less", F.lit(0))).select(*names))
        )
        open_rows = materialize(differ.select("digest", "_k1", "_k2", "doc_id", "_n"))
        first = F.max(F.struct("doc_id", "_k1", "_k2"))
        todo = open_rows.groupBy("digest").agg(F.sum("_n").alias("group_size"), first.alias("_first"))
        todo = materialize(
            todo.select("digest", "group_size", F.col("_first.doc_id").alias("keep_id"), F.col("_first._k1").alias("keep_1"), F.col("_first._k2").alias("keep_2"))
        )


def exact_groups(docs: DataFrame, digest=sha_digest) -> DataFrame:
    """``resolve`` for a table: its digests and locators are written once, as the files that the stream reads."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "arrivals")
    arrival(docs, digest).write.parquet(f"{folder}/rows")
    source = spark.readStream.schema("digest string, doc_id bigint, _k1 bigint, _k2 bigint")
    arrivals = source.option("maxFilesPerTrigger", PER_TRIGGER).parquet(f"{folder}/rows")
    return resolve(docs, dedup_stream(arrivals, f"{folder}/stream"), digest)


def drop_copies(docs: DataFrame, digest=sha_digest) -> DataFrame:
    """``docs`` without copies: of equal texts the row with the largest doc_id stays, with all its columns.

    Null texts count as empty, and null doc_ids as smaller than any other. Of rows that share the largest doc_id and
    the text, one stays. An empty table stays empty.
    """
    groups = exact_groups(docs, digest)
    kept = groups.filter((F.col("_k1") == F.col("keep_1")) & (F.col("_k2") == F.col("keep_2")))
    kept = kept.select("_k1", "_k2").hint("shuffle_merge")
    return whole_rows(docs, "doc_id").join(kept, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select("_row.*")


def op5_exact_dedup(spark, folder):
    """Rows that repeat doc_id and text share the values of one result row and are all returned."""
    docs = read_documents(spark, folder)
    groups = exact_groups(docs)
    rows = arrival(docs).select("doc_id", "_k1", "_k2", F.col("digest").alias("text_sha256"))
    stays = (F.col("_k1") == F.col("keep_1")) & (F.col("_k2") == F.col("keep_2"))
    joined = rows.join(groups.drop("digest").hint("shuffle_merge"), ["_k1", "_k2"])
    return joined.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
