"""Document fingerprints: the k smallest hashes of a document's five-word shingles; built-in expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.spread import checked_join
from .common import let, materialize, read_documents, whole_text

K = 256
WORDS = 5
ROWS_PER_BUCKET = 1_500
KNOTS = 64


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """Distinct 64-bit hashes of all ``n``-word shingles. Shorter texts are one shingle, texts without words none."""

    def windows(h: Column) -> Column:
        cells = lambda i: [F.get(h, i + j) for j in range(n)]
        return (
            F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
            .when(F.size(h) < n, F.array(F.xxhash64(h)))
            .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*cells(i))))
        )

    words = F.array_remove(F.split(F.lower(text), r"[ \t-\r]+", -1), "")
    return F.array_distinct(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    """The bottom-k sketch of ``text``: sorted, distinct, at most ``k`` hashes; all hashes when there are fewer."""
    return bottom_k(shingle_hashes(text, n), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return bottom_k(F.array_union(a, b), k)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    span = F.element_at(a, -1).cast("double") / 2.0**64 + 0.5
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated intersection over union; 1 for two empty sketches, exact while the union has at most ``k`` hashes."""

    def share(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(u, a), b))
        return F.when(F.size(u) == 0, 1.0).otherwise(both / F.size(u))

    return let(merge(a, b, k), share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, between 0 and 1; 1 for an empty ``a``."""
    r = resemblance(a, b, k)
    both = r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merge_groups(sketches: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per group from the sketches of its parts.

    Ranks stop at ``k`` before and after the shuffle, so no group is gathered: a task sends at most ``k`` hashes of
    each group. Null sketches count as empty.
    """
    if k >= 1000:
        raise ValueError("k has to be below 1000 for ranks to stop early")
    hashes = sketches.select(*keys, F.explode(column).alias("_h")).groupBy(*keys, "_h").agg(F.lit(1).alias("_one"))
    ranked = hashes.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_h"))).filter(F.col("_r") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def with_next(docs: DataFrame) -> DataFrame:
    """Columns doc_id, ``text`` (null: empty), ``next_text``, ``fp``, ``next_fp``; next is by doc_id, circular.

    Documents are put into buckets of neighbouring ids: 64 quantiles of the ids are the knots of a rising line, whose
    value is the bucket. The first document of each bucket is also sent to the bucket before it, so that a window
    inside a bucket sees every next document. Text is shuffled once. Ties in doc_id are ordered by a hash of the row;
    a null doc_id comes first. A single document is its own next.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    stats = rows.agg(
        F.count(F.lit(1)), F.percentile_approx("doc_id", [i / KNOTS for i in range(KNOTS + 1)], 10_000)
    ).first()
    count, knots = stats[0], sorted(set(stats[1] or [0]))
    buckets = max(1, math.ceil(count / ROWS_PER_BUCKET))
    rate = buckets / max(1, len(knots) - 1)
    line = F.lit(0.0)
    for i in range(len(knots) - 1):
        inside = (F.col("doc_id") - knots[i]) / F.lit(float(knots[i + 1] - knots[i]))
        line = F.when(F.col("doc_id") >= knots[i], (i + F.least(inside, F.lit(1.0))) * rate).otherwise(line)
    bucket = F.coalesce(F.least(F.floor(line), F.lit(buckets - 1)), F.lit(0))
    rows = rows.withColumn("_tie", F.xxhash64("doc_id", "text")).withColumn("_bucket", bucket)

    first = rows.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_tie")).alias("_first"))
    order = W.orderBy("_bucket")  # one row per bucket
    before = F.coalesce(F.lag("_bucket").over(order), F.last("_bucket").over(order.rowsBetween(0, W.unboundedFollowing)))
    first = materialize(first.select("_bucket", F.col("_first")["_tie"].alias("_tie"), before.alias("_before")))
    sent = checked_join(rows, first, ["_bucket", "_tie"], rows=buckets, how="left")
    places = F.when(F.col("_before").isNull(), F.array(F.struct("_bucket", F.lit(False).alias("_copy")))).otherwise(
        F.array(
            F.struct("_bucket", F.lit(False).alias("_copy")),
            F.struct(F.col("_before").alias("_bucket"), F.lit(True).alias("_copy")),
        )
    )
    sent = sent.select("doc_id", "text", "_tie", F.explode(places).alias("_place")).select(
        "doc_id", "text", "_tie", "_place.*"
    )
    inside = W.partitionBy("_bucket").orderBy("_copy", F.asc_nulls_first("doc_id"), "_tie")
    return (
        sent.withColumn("next_text", F.lead("text").over(inside))
        .withColumn("fp", sketch(F.col("text")))
        .withColumn("next_fp", F.lead("fp").over(inside))
        .filter(~F.col("_copy"))
        .drop("_tie", "_bucket", "_copy")
    )


def op4_fingerprints(spark, folder):
    """Fingerprint of each text and of its edited form, with their likeness and that to the next document."""
    pairs = with_next(read_documents(spark, folder))
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next_text", F.lit(1), half))
    pairs = pairs.withColumn("n_chars", chars.cast("bigint")).withColumn("edited", edited)
    pairs = pairs.withColumn("edited_fp", sketch(F.col("edited")))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
        distinct_count(F.col("fp")).alias("n_shingles"),
        containment(F.col("fp"), F.col("edited_fp")).alias("kept_share"),
    )
