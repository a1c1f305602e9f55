"""Line dedup: lines that many documents share are dropped everywhere; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, materialize, read_documents, row_key, tiered_join, whole_rows, whole_text


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Lines are exploded as 128-bit hashes of their keys with their positions, hashes found in ``min_docs`` or more
    documents are joined back, and a document is reassembled from the positions that remain. Text moves once, to meet
    the positions. A hash counts each document once; the join splits hashes that many lines share.

    Null and empty texts are one empty line. Rows that are equal in doc_id and text are one document each for the
    count only if their doc_ids differ; each is returned with the same result. Null doc_ids are allowed. A column of
    ``docs`` that has the name of an output column is replaced.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    key = row_key(F.col("doc_id"), whole_text())
    names = ["_k1", "_k2"]
    lines = (
        docs.select(*key, F.posexplode(F.split(whole_text(), "\n", -1)).alias("_at", "_line"))
        .withColumn("_line", line_key(F.col("_line")))
        .filter(F.char_length("_line") >= min_chars)
        .select(*names, "_at", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit("second"), "_line").alias("_h2"))
    )
    lines = materialize(lines)
    per_doc = lines.groupBy("_h1", "_h2", *names).agg(F.count(F.lit(1)).alias("_n"))
    shared = materialize(
        per_doc.groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_docs"), F.sum("_n").alias("_rows"))
        .filter(F.col("_docs") >= min_docs)
        .drop("_docs")
    )
    dropped = tiered_join(lines, shared, ["_h1", "_h2"], "_rows").groupBy(*names).agg(F.collect_set("_at").alias("_gone"))
    split = F.split(whole_text("_row.text"), "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    kept = (
        whole_rows(docs, "doc_id")
        .join(dropped.hint("shuffle_merge"), names, "left")
        .withColumn("_lines", split)
        .withColumn("_stays", stays)
        .withColumn("n_lines", F.size("_lines").cast("bigint"))
        .withColumn("n_dropped", (F.size("_lines") - F.size("_stays")).cast("bigint"))
        .withColumn("kept_text", F.array_join(F.transform("_stays", lambda i: F.get(F.col("_lines"), i)), "\n"))
    )
    return kept.select("_row.*", "n_lines", "n_dropped", "kept_text")


def op3_line_dedup(spark, folder):
    kept = drop_shared_lines(read_documents(spark, folder))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (s.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key
GROUP BY doc_id
"""
