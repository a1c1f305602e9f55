"""Mixing sources to target weights by temperature; built-in expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, materialize, read_documents, row_key, tiered_join, whole_rows, whole_text

REPEAT_LIMIT = 2.0
BLOCK_SHARE = 64
SLICES = 4_096
HALVINGS = 40
STEPS = 6


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("bigint")


def solve_exponent(totals: DataFrame, entropy: float | None = None, repeat_limit: float | None = None) -> float:
    """The exponent a in [0, 1] for which weights proportional to ``tokens ** a`` meet the target, by bisection.

    With ``entropy`` (nats): the largest a whose weights have at least that entropy, or 0 where none has. With
    ``repeat_limit``: the smallest a for which no source is repeated more often than that, if the source that is
    repeated least is taken once. Both measures fall as a grows. ``STEPS`` halvings are made by one job, which
    evaluates all their 63 possible points, over however many sources there are.
    """
    if (entropy is None) == (repeat_limit is None):
        raise ValueError("give either entropy or repeat_limit")
    if repeat_limit is not None and repeat_limit < 1:
        raise ValueError("repeat_limit is at least 1")
    low, high = 0.0, 1.0
    for _ in range(math.ceil(HALVINGS / STEPS)):
        parts = 2**STEPS
        grid = [low + (high - low) * i / parts for i in range(1, parts)]
        power = F.exp(F.col("a") * F.ln("p"))
        at = (
            totals.withColumn("a", F.explode(F.array(*map(F.lit, grid))))
            .groupBy("a")
            .agg(F.sum(power).alias("z"), F.sum(power * F.ln("p")).alias("s"), F.max(power / F.col("p")).alias("most"), F.min(power / F.col("p")).alias("least"))
        )
        rows = sorted(at.collect(), key=lambda r: r["a"])  # 63 rows
        if entropy is not None:
            over = [math.log(r["z"]) - r["a"] * r["s"] / r["z"] >= entropy for r in rows]
        else:
            over = [r["most"] / r["least"] > repeat_limit for r in rows]
        edge = sum(over)
        low, high = low + (high - low) * edge / parts, low + (high - low) * (edge + 1) / parts
    return low if entropy is not None else high


def mix(
    docs: DataFrame,
    *,
    entropy: float | None = None,
    repeat_limit: float | None = REPEAT_LIMIT,
    budget: int | None = None,
    seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """Emissions and sources of a mixture.

    Sources (one row each): ``source``, ``tokens``, ``weight``, ``quota``. Weights are the token shares to the solved
    exponent, normalised. ``budget`` tokens are dealt by weight; without it, the smallest budget that takes every
    source at least once, so nothing is lost. Emissions: ``doc_id``, ``source``, ``n_tokens``, ``pass``, ``block``,
    ``rank`` and the row's key. A source is a stream of passes, each a fresh permutation of its documents by hash; the
    stream ends at the quota (the document that reaches it is whole). The stream is cut into blocks of a 64th of the
    quota, so every block of all sources together has the mixture's weights; inside a block documents are permuted by
    ``rank``.

    The running token count inside a pass uses 4,096 hash slices: their totals are added up per source, and only the
    rows of one slice are ordered together, so a source with a third of all rows is spread over many tasks.

    A null source is a source of its own. Documents without tokens are emitted once per pass with their place. A source
    without any tokens is taken once. Rows that repeat doc_id and text count once, with a number of repeats that every
    emission carries as ``copies``. An empty table gives empty results.
    """
    rows = docs.select("doc_id", "source", whole_text().alias("text")).select(
        "doc_id", "source", *row_key(F.col("doc_id"), F.col("source"), F.col("text")), token_count(F.col("text")).alias("n_tokens")
    )
    rows = rows.groupBy("_k1", "_k2").agg(
        F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("copies")
    )
    rows = materialize(
        rows.withColumn("weighs", F.col("n_tokens") * F.col("copies")).withColumn("_s", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    )
    totals = materialize(
        rows.groupBy("_s").agg(F.sum("weighs").alias("tokens"), F.count(F.lit(1)).alias("_rows"), F.first("source").alias("source"))
    )
    total = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    filled = totals.filter(F.col("tokens") > 0).select((F.col("tokens") / F.lit(float(max(total, 1)))).alias("p"))
    a = solve_exponent(filled, entropy, repeat_limit if entropy is None else None) if total else 1.0
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    raw = F.when(F.col("tokens") > 0, F.exp(F.lit(a) * F.ln(share))).otherwise(0.0)
    z, largest = totals.agg(F.sum(raw), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / raw))).first()
    spend = budget if budget is not None else (largest or 0.0) * (z or 0.0)
    quota = F.floor(F.col("weight") * F.lit(float(spend)) + F.lit(1e-6)).cast("bigint")
    sources = totals.withColumn("weight", raw / F.lit(float(z or 1.0))).withColumn("quota", quota)
    sources = materialize(sources.select("_s", "source", "tokens", "_rows", "weight", "quota"))

    dealt = tiered_join(rows.drop("source"), sources, ["_s"], "_rows")
    passes = F.when(F.col("tokens") > 0, F.ceil(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1).cast("bigint"))
    dealt = dealt.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(passes, F.lit(1).cast("bigint")) - 1)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = lambda *x: F.md5(F.concat_ws(":", F.lit(seed), *x))
    dealt = dealt.withColumn("_h", digest(F.col("pass").cast("string"), name))
    dealt = dealt.withColumn("_slice", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    slices = dealt.groupBy("_s", "pass", "_slice").agg(F.sum("weighs").alias("_sum"), F.count(F.lit(1)).alias("_dealt"))
    before = W.partitionBy("_s", "pass").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = materialize(slices.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum"))
    dealt = dealt.join(slices.hint("shuffle_merge"), ["_s", "pass", "_slice"])
    within = W.partitionBy("_s", "pass", "_slice").orderBy("_h", "doc_id", "_k1", "_k2").rowsBetween(W.unboundedPreceding, -1)
    begin = F.col("pass") * F.col("tokens") + F.col("_before") + F.coalesce(F.sum("weighs").over(within), F.lit(0))
    dealt = dealt.withColumn("_begin", begin)
    taken = (F.col("_begin") < F.col("quota")) | (F.col("tokens") == 0) | ((F.col("weighs") == 0) & (F.col("pass") == 0))
    block = F.least(F.floor(F.col("_begin") * BLOCK_SHARE / F.greatest("quota", F.lit(1))), F.lit(BLOCK_SHARE - 1)).cast("bigint")
    emitted = dealt.filter(taken).withColumn("block", block)
    emitted = emitted.withColumn("rank", digest(F.col("block").cast("string"), F.col("pass").cast("string"), name))
    emitted = emitted.select("doc_id", "source", "n_tokens", "copies", "pass", "block", "rank", "_k1", "_k2")
    return emitted, sources.select("source", "tokens", "weight", "quota")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, in the mixture's order. Any further columns stay.

    Rows are written block by block and by rank inside a block, so every part of what is written has the mixture's
    weights. Ranges are cut by block and rank, so no block has to fit into one task.
    """
    emitted, _ = mix(docs, **how)
    times = materialize(emitted.select("_k1", "_k2", "block", "rank"))
    give_back(docs.sparkSession)
    taken = whole_rows(docs, "doc_id", "source").join(times.hint("shuffle_merge"), ["_k1", "_k2"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return taken.repartitionByRange(parts, "block", "rank").sortWithinPartitions("block", "rank").select("_row.*")


def op7_mixing(spark, folder):
    emitted, _ = mix(read_documents(spark, folder))
    return emitted.select("doc_id", "source", "n_tokens", "copies", "pass", "block", "rank")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, any_value(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')))::BIGINT AS n_tokens, count(*) AS copies
  FROM documents GROUP BY doc_id, source, coalesce(text, '')
), s AS (
  SELECT source, sum(n_tokens * copies)::BIGINT AS tokens FROM d GROUP BY source
), p AS (
  SELECT source, tokens, tokens / (SELECT sum(tokens) FROM s)::DOUBLE AS p FROM s
), bisect(i, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN r > 2 THEN mid ELSE low END, CASE WHEN r > 2 THEN high ELSE mid END
  FROM (SELECT i, low, high, (low + high) / 2 AS mid,
    (SELECT max(exp((b.low + b.high) / 2 * ln(p)) / p) / min(exp((b.low + b.high) / 2 * ln(p)) / p) FROM p) AS r
    FROM bisect b WHERE i < 42)
), w AS (
  SELECT source, tokens, exp((SELECT high FROM bisect WHERE i = 42) * ln(p)) AS raw FROM p
), q AS (
  SELECT source, tokens, floor(raw / z * (most * z) + 1e-6)::BIGINT AS quota
  FROM w, (SELECT sum(raw) AS z, max(tokens / raw) AS most FROM w)
), e AS (
  SELECT doc_id, d.source, n_tokens, copies, tokens, quota, unnest(range(greatest(1, ceil(quota / tokens)::BIGINT))) AS pass
  FROM d JOIN q ON d.source = q.source
), h AS (
  SELECT *, md5('mix:' || pass || ':' || doc_id) AS h FROM e
), b AS (
  SELECT *, (pass * tokens + coalesce(sum(n_tokens * copies) OVER (PARTITION BY source, pass ORDER BY h, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS at_token FROM h
), t AS (
  SELECT *, least(floor(at_token * 64 / greatest(quota, 1)), 63)::BIGINT AS block FROM b
  WHERE at_token < quota OR (n_tokens = 0 AND pass = 0)
)
SELECT doc_id, source, n_tokens, copies, pass, block, md5('mix:' || block || ':' || pass || ':' || doc_id) AS rank FROM t
"""
