"""Queries over the given tables, one per operator, with equivalent SQL where SQL can say it.

Two stand-ins feed them. *Series*: ``lineitem`` with one channel per supplier, ordered by date, and the price in
cents around its floored channel mean as the value; all values are whole numbers, so sums are exact in any order.
*Vectors*: ``embeddings``, with the label as channel where a query needs channels.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.butterworth import bandpass_coefficients
from .functions.rules import cluster_count
from .functions.vectors import doubles
from .operators import cluster as clusters
from .operators import detect, kmeans, merge, mixture, svm
from .operators.bandpass import bandpass, bandpass_joined, warm_up
from .operators.moments import covariance
from .operators.reduce import extract_features, library_pca, pca_features
from .operators.report import run_report, scatter_2d
from .plans.pipeline import Sorted, sort_blocks
from .plans.select import exact_median
from .plans.spread import checked_join, materialize, spread
from .session import KEYS, checkpoint_folder
from .sources.recording import read_recording
from .sources.sinks import commit_result, read_result, write_recording
from .sources.series import centre, explode_blocks, first_interval, series_from_table, signal_blocks, split_intervals, with_time

Query = Callable[[SparkSession, str], DataFrame]

BLOCK = 64
WINDOW, OFFSET, FACTOR, LIMIT = 5, 2, 1.5, 4_500_000.0
WIDTH = 64
SERIES_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def rounded(value: Column | str, digits: int) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# ---------------------------------------------------------------- series


def price_series(spark: SparkSession, folder: str, write: bool = True) -> DataFrame:
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_suppkey", *SERIES_ORDER)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    series = series_from_table(lines, F.col("l_suppkey"), SERIES_ORDER, cents, "lineitem")
    return centre(series, write)


def price_blocks(spark: SparkSession, folder: str) -> DataFrame:
    lead, tail = detect.lead_needed(WINDOW, OFFSET), detect.tail_needed(WINDOW, OFFSET)
    return materialize(signal_blocks(price_series(spark, folder, write=False), BLOCK, lead, tail, values="y"))


SERIES_SQL = """
WITH priced AS (
  SELECT l_suppkey AS channel, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         row_number() OVER (PARTITION BY l_suppkey
                            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS sample
  FROM lineitem),
means AS (SELECT channel, CAST(floor(sum(cents) / count(*)) AS BIGINT) AS mean FROM priced GROUP BY channel),
series AS (SELECT channel, sample, CAST(cents - mean AS DOUBLE) AS value FROM priced JOIN means USING (channel))
"""
LEVEL_SQL = SERIES_SQL + """,
levels AS (SELECT channel, count(*) AS n_samples, sum(abs(value)) / count(*) * 1.5 AS thresh
           FROM series GROUP BY channel)
"""
PEAK_SQL = LEVEL_SQL + """,
windows AS (
  SELECT channel, sample AS pos, value, max(value) OVER w AS top, list(value) OVER w AS ahead
  FROM series WINDOW w AS (PARTITION BY channel ORDER BY sample ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
peaks AS (
  SELECT channel, n_samples, pos, pos + list_position(ahead, top) - 1 AS peak FROM windows JOIN levels USING (channel)
  WHERE value > thresh AND pos > 5 AND pos < n_samples - 6 AND top < 4500000)
"""
EVENT_SQL = PEAK_SQL + """,
followed AS (SELECT *, lead(peak) OVER (PARTITION BY channel ORDER BY pos) AS later FROM peaks),
found AS (SELECT channel, pos, peak FROM followed WHERE later - peak > 1 AND peak + 7 <= n_samples)
"""
WAVE_SQL = EVENT_SQL + """,
cells AS (SELECT f.channel, f.peak, s.sample - (f.peak - 3) AS i, s.value FROM found f
          JOIN series s ON s.channel = f.channel AND s.sample >= f.peak - 3 AND s.sample < f.peak + 7),
spans AS (SELECT channel, peak, min(value) AS low, max(value) + min(value) AS span FROM cells GROUP BY channel, peak)
"""


@query(
    "signal_blocks",
    SERIES_SQL
    + """, sized AS (SELECT channel, sample // 64 AS block, count(*) AS n_core FROM series GROUP BY ALL)
    SELECT channel, block, block * 64 AS start, n_core, sample, value
    FROM (SELECT *, sample // 64 AS block FROM series) JOIN sized USING (channel, block)""",
)
def _signal_blocks(spark: SparkSession, folder: str) -> DataFrame:
    blocks = signal_blocks(price_series(spark, folder), BLOCK)
    cells = blocks.select("channel", "block", "start", long("n_core"), F.posexplode("samples").alias("_i", "value"))
    return cells.select("channel", "block", "start", "n_core", (F.col("start") + F.col("_i")).alias("sample"), "value")


EVENT_SERIES_SQL = """WITH s AS (
  SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, value FROM events)
"""


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "ts", "event_id", "value")
    return split_intervals(series_from_table(rows, F.col("user_id"), ["ts", "event_id"], F.col("value"), "events"), 16)


@query(
    "intervals",
    EVENT_SERIES_SQL
    + "SELECT channel, place // 16 AS interval_id, place % 16 AS sample, (place % 16) / 30000.0::DOUBLE AS seconds, value FROM s",
)
def _intervals(spark: SparkSession, folder: str) -> DataFrame:
    timed = with_time(event_series(spark, folder), 30000)
    return timed.select("channel", long("interval_id"), "sample", "seconds", "value")


@query("first_interval", EVENT_SERIES_SQL + "SELECT channel, place AS sample, value FROM s WHERE place < 16")
def _first_interval(spark: SparkSession, folder: str) -> DataFrame:
    return first_interval(event_series(spark, folder)).select("channel", "sample", "value")


@query("noise_threshold", LEVEL_SQL + "SELECT channel, n_samples, thresh FROM levels")
def _noise_threshold(spark: SparkSession, folder: str) -> DataFrame:
    blocks = signal_blocks(price_series(spark, folder), BLOCK, values="y")
    return detect.noise_thresholds(blocks, FACTOR).select("channel", "n_samples", "thresh")


@query(
    "threshold_crossings",
    LEVEL_SQL
    + """SELECT channel, sample AS pos, value FROM series JOIN levels USING (channel)
    WHERE value > thresh AND sample > 5 AND sample < n_samples - 6""",
)
def _threshold_crossings(spark: SparkSession, folder: str) -> DataFrame:
    return detect.threshold_crossings(price_blocks(spark, folder), WINDOW, FACTOR).select("channel", "pos", "value")


@query("aligned_peaks", PEAK_SQL + "SELECT channel, pos, peak FROM peaks")
def _aligned_peaks(spark: SparkSession, folder: str) -> DataFrame:
    return detect.aligned_peaks(price_blocks(spark, folder), WINDOW, FACTOR, LIMIT).select("channel", "pos", "peak")


def price_events(spark: SparkSession, folder: str, min_events: int = 1) -> DataFrame:
    return detect.detect_events(price_blocks(spark, folder), WINDOW, FACTOR, OFFSET, LIMIT, min_events=min_events)


@query("dedup_events", EVENT_SQL + "SELECT channel, pos, peak FROM found")
def _dedup_events(spark: SparkSession, folder: str) -> DataFrame:
    return price_events(spark, folder).select("channel", "pos", "peak")


@query(
    "busy_channels",
    EVENT_SQL + "SELECT channel, count(*) AS events, min(peak) AS first_peak FROM found GROUP BY channel HAVING count(*) >= 2",
)
def _busy_channels(spark: SparkSession, folder: str) -> DataFrame:
    events = price_events(spark, folder, min_events=2)
    return events.groupBy("channel").agg(F.count(F.lit(1)).alias("events"), F.min("peak").alias("first_peak"))


@query(
    "waveforms_normalised",
    WAVE_SQL
    + """SELECT channel, peak, i, (value + low) / span AS value
    FROM cells JOIN spans USING (channel, peak) WHERE span <> 0""",
)
def _waveforms_normalised(spark: SparkSession, folder: str) -> DataFrame:
    waves = detect.normalise_waves(price_events(spark, folder))
    return waves.select("channel", "peak", F.posexplode("wave").alias("i", "value")).select("channel", "peak", long("i"), "value")


@query(
    "waveform_ranges",
    WAVE_SQL + "SELECT channel, peak, min(value) AS low, max(value) AS high FROM cells GROUP BY channel, peak",
)
def _waveform_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return price_events(spark, folder).select("channel", "peak", F.array_min("wave").alias("low"), F.array_max("wave").alias("high"))


def _filter_sql(low: float, high: float) -> str:
    """The filter as a recursion over the samples of a channel."""
    b, a = bandpass_coefficients(low, high, 30_000)
    values = ", ".join(f"{float(v)!r}::DOUBLE" for v in (b[0], b[2], b[4], *a[1:]))
    return (
        SERIES_SQL.replace("WITH priced", "WITH RECURSIVE priced")
        + f""", c(b0, b2, b4, a1, a2, a3, a4) AS (SELECT {values}),
    x AS (SELECT channel, sample, value / 100000.0::DOUBLE AS v FROM series),
    run AS (
      SELECT channel, sample, b0 * v AS y, -a1 * (b0 * v) AS s1, b2 * v - a2 * (b0 * v) AS s2, -a3 * (b0 * v) AS s3,
             b4 * v - a4 * (b0 * v) AS s4 FROM x, c WHERE sample = 0
      UNION ALL
      SELECT x.channel, x.sample, b0 * v + s1, s2 - a1 * (b0 * v + s1), s3 + b2 * v - a2 * (b0 * v + s1),
             s4 - a3 * (b0 * v + s1), b4 * v - a4 * (b0 * v + s1)
      FROM run JOIN x ON x.channel = run.channel AND x.sample = run.sample + 1, c)
    SELECT channel, sample, round(y, 4) + 0.0 AS y FROM run"""
    )


@query("bandpass_joined", _filter_sql(300, 330))
def _bandpass_joined(spark: SparkSession, folder: str) -> DataFrame:
    """A narrow band, whose states last over many blocks, on blocks without neighbours."""
    scaled = price_series(spark, folder).withColumn("value", F.col("value") / F.lit(100000.0))
    blocks = materialize(signal_blocks(scaled, BLOCK))
    filtered = bandpass_joined(blocks, 300, 330, fan=4)
    return explode_blocks(filtered, "y").select("channel", "sample", rounded("value", 4).alias("y"))


@query(
    "bandpass",
    SERIES_SQL.replace("WITH priced", "WITH RECURSIVE priced")
    + """, c(b0, b2, b4, a1, a2, a3, a4) AS (SELECT 0.19061660009749765::DOUBLE, -0.3812332001949953::DOUBLE,
        0.19061660009749765::DOUBLE, -2.3350824020765124::DOUBLE, 1.9509646897792021::DOUBLE, -0.8192636853124013::DOUBLE,
        0.20667198516656435::DOUBLE),
    x AS (SELECT channel, sample, value / 100000.0::DOUBLE AS v FROM series),
    run AS (
      SELECT channel, sample, b0 * v AS y, -a1 * (b0 * v) AS s1, b2 * v - a2 * (b0 * v) AS s2, -a3 * (b0 * v) AS s3,
             b4 * v - a4 * (b0 * v) AS s4 FROM x, c WHERE sample = 0
      UNION ALL
      SELECT x.channel, x.sample, b0 * v + s1, s2 - a1 * (b0 * v + s1), s3 + b2 * v - a2 * (b0 * v + s1),
             s4 - a3 * (b0 * v + s1), b4 * v - a4 * (b0 * v + s1)
      FROM run JOIN x ON x.channel = run.channel AND x.sample = run.sample + 1, c)
    SELECT channel, sample, round(y, 4) + 0.0 AS y FROM run""",
)
def _bandpass(spark: SparkSession, folder: str) -> DataFrame:
    scaled = price_series(spark, folder).withColumn("value", F.col("value") / F.lit(100000.0))
    filtered = bandpass(signal_blocks(scaled, 512, lead=warm_up()))
    return explode_blocks(filtered, "y").select("channel", "sample", rounded("value", 4).alias("y"))


# ---------------------------------------------------------------- vectors

EMB_SQL = "WITH emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
D2 = "list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
UNIFORM_SQL = "((('0x' || substr(md5('1:{step}:' || vec_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


def vectors(spark: SparkSession, folder: str, channel: Column | None = None, dims: int = WIDTH) -> DataFrame:
    """``keys…, event_id, x, label``; one channel for all vectors unless ``channel`` says otherwise."""
    raw = spark.read.parquet(f"{folder}/embeddings.parquet")
    x = doubles(F.col("embedding"))
    return raw.select(
        F.lit("embeddings").alias("recording"),
        F.lit(0).alias("interval_id"),
        (F.lit(0) if channel is None else channel).cast("int").alias("channel"),
        F.col("vec_id").alias("event_id"),
        (x if dims == WIDTH else F.slice(x, 1, dims)).alias("x"),
        "label",
    )


def given_centers(points: DataFrame, k: int) -> DataFrame:
    """The vectors with ids below ``k`` as start centres."""
    rows = F.array_sort(F.collect_list(F.struct("event_id", "x")))
    return points.filter(F.col("event_id") < k).groupBy(*KEYS).agg(F.flatten(rows["x"]).alias("centers"))


@query(
    "cluster_count_rule",
    "SELECT user_id, count(*) AS n, least(10, greatest(3, CAST(ceil(count(*) / 100.0) AS BIGINT))) AS k FROM events GROUP BY user_id",
)
def _cluster_count_rule(spark: SparkSession, folder: str) -> DataFrame:
    counts = spark.read.parquet(f"{folder}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("user_id", "n", cluster_count(F.col("n")).cast("bigint").alias("k"))


@query(
    "column_means",
    EMB_SQL + ", d AS (SELECT unnest(range(64)) AS i) SELECT label, i, round(avg(x[i + 1]), 8) + 0.0 AS mean FROM emb, d GROUP BY ALL",
)
def _column_means(spark: SparkSession, folder: str) -> DataFrame:
    from .operators.moments import group_means

    means = group_means(spread(vectors(spark, folder, F.col("label")), KEYS).chunks(["x"]))
    cells = means.select(F.col("channel").alias("label"), F.posexplode("mean").alias("i", "m"))
    return cells.select("label", long("i"), rounded("m", 8).alias("mean"))


@query(
    "covariance",
    EMB_SQL
    + """, d AS (SELECT unnest(range(64)) AS i), e AS (SELECT i AS j FROM d)
    SELECT label, i, j, round(covar_pop(x[i + 1], x[j + 1]), 8) + 0.0 AS cov FROM emb, d, e WHERE i <= j GROUP BY ALL""",
)
def _covariance(spark: SparkSession, folder: str) -> DataFrame:
    points = vectors(spark, folder, F.col("label"))
    found = covariance(spread(points, KEYS).chunks(["x"]))
    places = F.flatten(
        F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.transform(F.sequence(i, F.lit(WIDTH - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )
    cells = found.select(F.col("channel").alias("label"), F.explode(F.arrays_zip(places.alias("at"), "cov")).alias("c"))
    return cells.select("label", F.col("c.at.i").cast("bigint").alias("i"), F.col("c.at.j").cast("bigint").alias("j"), rounded("c.cov", 8).alias("cov"))


@query("pca_project")
def _pca_project(spark: SparkSession, folder: str) -> DataFrame:
    return pca_features(vectors(spark, folder, F.col("label")), 10, column="x").select("channel", "event_id", "x")


@query("pca_pooled")
def _pca_pooled(spark: SparkSession, folder: str) -> DataFrame:
    return pca_features(vectors(spark, folder, F.col("label")), 10, basis="pooled", column="x").select("channel", "event_id", "x")


FACTS_SQL = EMB_SQL + """, d AS (SELECT unnest(range(64)) AS i),
v AS (SELECT {by} AS channel, i, var_pop(x[i + 1]) * count(*) AS energy, count(*) AS n FROM emb, d GROUP BY ALL)
SELECT channel, any_value(n) AS n, round(sum(energy), 6) + 0.0 AS energy, true AS centred, true AS uncorrelated, true AS falling FROM v GROUP BY channel"""


def component_facts(features: DataFrame, width: int = WIDTH) -> DataFrame:
    """What fixes principal components up to their signs: mean zero, no covariances, falling variances, all energy."""
    found = covariance(spread(features, KEYS).chunks(["x"]))
    diagonal = F.array(*[F.get("cov", F.lit(i * width - i * (i - 1) // 2)) for i in range(width)])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v))
    facts = found.withColumn("_d", diagonal)
    steps = F.zip_with(F.slice("_d", 1, width - 1), F.slice("_d", 2, width - 1), lambda a, b: a >= b - 1e-9)
    return facts.select(
        long("channel"),
        "n",
        rounded(F.col("n") * total(F.col("_d")), 6).alias("energy"),
        F.forall("mean", lambda m: F.abs(m) < 1e-9).alias("centred"),
        (total(F.col("cov")) - total(F.col("_d")) < 1e-8).alias("uncorrelated"),
        F.forall(steps, lambda s: s).alias("falling"),
    )


@query("pca_project_facts", FACTS_SQL.format(by="label"))
def _pca_project_facts(spark: SparkSession, folder: str) -> DataFrame:
    return component_facts(pca_features(vectors(spark, folder, F.col("label")), WIDTH, column="x"))


@query("pca_pooled_facts", FACTS_SQL.format(by="0::BIGINT"))
def _pca_pooled_facts(spark: SparkSession, folder: str) -> DataFrame:
    found = pca_features(vectors(spark, folder, F.col("label")), WIDTH, basis="pooled", column="x")
    return component_facts(found.withColumn("channel", F.lit(0)))


@query("mlpca")
def _mlpca(spark: SparkSession, folder: str) -> DataFrame:
    return extract_features(vectors(spark, folder), "mlpca", 10, column="x").select("event_id", "x")


@query("library_pca")
def _library_pca(spark: SparkSession, folder: str) -> DataFrame:
    return library_pca(vectors(spark, folder), 10, "x").select("event_id", "x")


@query("mlpca_facts", FACTS_SQL.format(by="0::BIGINT"))
def _mlpca_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The features that the whole job extracts under the name ``mlpca``."""
    found = extract_features(vectors(spark, folder, F.col("label")), "mlpca", WIDTH, column="x")
    return component_facts(found.withColumn("channel", F.lit(0)))


LLOYD_SQL = EMB_SQL + f""",
c0 AS (SELECT vec_id AS c, x AS m FROM emb WHERE vec_id < 5),
d0 AS (SELECT vec_id, emb.x AS x, c, {D2.format(a="emb.x", b="m")} AS d2 FROM emb, c0),
a0 AS (SELECT vec_id, any_value(x) AS x, arg_min(c, (d2, c)) AS cluster FROM d0 GROUP BY vec_id),
u AS (SELECT cluster, i, avg(x[i]) AS v FROM a0, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
moved AS (SELECT cluster AS c, list(v ORDER BY i) AS m FROM u GROUP BY cluster),
c1 AS (SELECT c, coalesce(moved.m, c0.m) AS m FROM c0 LEFT JOIN moved USING (c)),
d1 AS (SELECT vec_id, c, {D2.format(a="emb.x", b="m")} AS d2 FROM emb, c1),
a1 AS (SELECT vec_id, arg_min(c, (d2, c)) AS cluster, min(d2) AS d2 FROM d1 GROUP BY vec_id)
"""


def two_round_lloyd(spark: SparkSession, folder: str) -> DataFrame:
    points = vectors(spark, folder)
    placed, _ = kmeans.kmeans(spread(points, KEYS), F.lit(5), 5, WIDTH, max_iter=1, centers=given_centers(points, 5))
    return placed


@query("kmeans_lloyd", LLOYD_SQL + "SELECT vec_id, cluster, round(d2, 6) + 0.0 AS d2 FROM a1")
def _kmeans_lloyd(spark: SparkSession, folder: str) -> DataFrame:
    return two_round_lloyd(spark, folder).select(F.col("event_id").alias("vec_id"), long("cluster"), rounded("d2", 6).alias("d2"))


@query("kmeans_error", LLOYD_SQL + "SELECT cluster, count(*) AS n, round(sum(d2), 6) + 0.0 AS wsse FROM a1 GROUP BY cluster")
def _kmeans_error(spark: SparkSession, folder: str) -> DataFrame:
    errors = kmeans.cluster_error(two_round_lloyd(spark, folder), KEYS)
    return errors.select(long("cluster"), "n", rounded("wsse", 6).alias("wsse"))


def _race_sql(k: int) -> str:
    steps = [EMB_SQL, f"s0 AS (SELECT x AS m FROM emb ORDER BY {UNIFORM_SQL.format(step=0)}, vec_id LIMIT 1)"]
    so_far = "SELECT 0 AS seed, m FROM s0"
    for step in range(1, k):
        steps.append(f"g{step} AS ({so_far})")
        steps.append(
            f"r{step} AS (SELECT vec_id, any_value(x) AS x, min({D2.format(a='x', b='m')}) AS d2 FROM emb, g{step} GROUP BY vec_id)"
        )
        steps.append(
            f"s{step} AS (SELECT x AS m FROM r{step} WHERE d2 > 0 ORDER BY -ln({UNIFORM_SQL.format(step=step)}) / d2, vec_id LIMIT 1)"
        )
        so_far = f"SELECT * FROM g{step} UNION ALL SELECT {step} AS seed, m FROM s{step}"
    return ", ".join(steps) + f", g AS ({so_far}) SELECT CAST(seed AS BIGINT) AS seed, i - 1 AS i, m[i] AS value FROM g, (SELECT unnest(range(1, 65)) AS i)"


def seed_cells(seeds: DataFrame) -> DataFrame:
    at = seeds.select(F.posexplode("centers").alias("_p", "value"))
    return at.select(F.floor(F.col("_p") / WIDTH).cast("bigint").alias("seed"), (F.col("_p") % WIDTH).cast("bigint").alias("i"), "value")


@query("kmeanspp_seeds", _race_sql(4))
def _kmeanspp_seeds(spark: SparkSession, folder: str) -> DataFrame:
    points = spread(vectors(spark, folder), KEYS)
    row_bytes = kmeans.center_bytes(4, WIDTH)
    return seed_cells(kmeans.spread_out_seeds(points, points.chunks(["x"], row_bytes).settle(), F.lit(4), 4, row_bytes))


@query(
    "random_seeds",
    EMB_SQL
    + f""", r AS (SELECT x, row_number() OVER (ORDER BY {UNIFORM_SQL.format(step=0)}, vec_id) - 1 AS seed FROM emb)
    SELECT seed, i - 1 AS i, x[i] AS value FROM r, (SELECT unnest(range(1, 65)) AS i) WHERE seed < 15""",
)
def _random_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return seed_cells(kmeans.random_seeds(spread(vectors(spark, folder), KEYS), F.lit(15), 15))


def _full_lloyd_sql(seeds: str, group: str) -> str:
    """Twenty rounds from ``seeds`` (g, c, m) in the groups ``group`` of the vectors, then the assignment."""
    return f"""{seeds},
    points AS (SELECT vec_id, x, {group} AS g FROM emb),
    lloyd AS (
      SELECT 0 AS round, g, c, m FROM seeds
      UNION ALL
      (WITH cur AS (SELECT * FROM lloyd WHERE round < {kmeans.MAX_ITER}),
      gaps AS (SELECT round, cur.g, vec_id, x, c, {D2.format(a="x", b="m")} AS d2 FROM points JOIN cur ON cur.g = points.g),
      best AS (SELECT round, g, vec_id, any_value(x) AS x, arg_min(c, (d2, c)) AS c FROM gaps GROUP BY round, g, vec_id),
      cells AS (SELECT g, c, i, avg(x[i]) AS v FROM best, (SELECT unnest(range(1, 65)) AS i) GROUP BY g, c, i),
      moved AS (SELECT g, c, list(v ORDER BY i) AS m FROM cells GROUP BY g, c)
      SELECT round + 1, cur.g, cur.c, coalesce(moved.m, cur.m) FROM cur LEFT JOIN moved ON moved.g = cur.g AND moved.c = cur.c)
    ),
    gaps AS (SELECT lloyd.g, vec_id, c, {D2.format(a="x", b="m")} AS d2 FROM points JOIN lloyd ON lloyd.g = points.g WHERE round = {kmeans.MAX_ITER})
    """


RECURSIVE_EMB = EMB_SQL.replace("WITH emb", "WITH RECURSIVE emb", 1)
GROUP_K = "greatest(3, least(10, CAST(ceil(count(*) / 100.0) AS BIGINT)))"


def _group_race_sql(k_max: int) -> str:
    """k-means++ seeds of every label, by the race, as ``seeds``; a group wants as many as its size calls for."""
    steps = [RECURSIVE_EMB, f"wanted AS (SELECT label AS g, {GROUP_K} AS k FROM emb GROUP BY label)"]
    steps.append(f"s0 AS (SELECT label AS g, 0 AS c, x AS m FROM emb QUALIFY row_number() OVER (PARTITION BY label ORDER BY {UNIFORM_SQL.format(step=0)}, vec_id) = 1)")
    for step in range(1, k_max):
        known = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(step))
        steps.append(
            f"""s{step} AS (WITH known AS ({known}),
            away AS (SELECT label AS g, vec_id, any_value(x) AS x, min({D2.format(a="x", b="m")}) AS d2 FROM emb JOIN known ON known.g = label GROUP BY label, vec_id)
            SELECT away.g, {step} AS c, x AS m FROM away JOIN wanted ON wanted.g = away.g WHERE d2 > 0 AND k > {step}
            QUALIFY row_number() OVER (PARTITION BY away.g ORDER BY -ln({UNIFORM_SQL.format(step=step)}) / d2, vec_id) = 1)"""
        )
    return ", ".join(steps) + ", seeds AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(k_max)) + ")"


@query(
    "kmeans",
    _full_lloyd_sql(_group_race_sql(10), "label")
    + "SELECT CAST(g AS BIGINT) AS channel, vec_id AS event_id, CAST(arg_min(c, (d2, c)) AS BIGINT) AS cluster FROM gaps GROUP BY g, vec_id",
)
def _kmeans(spark: SparkSession, folder: str) -> DataFrame:
    """All rounds, per channel."""
    placed = clusters.cluster_events(vectors(spark, folder, F.col("label")), "km", WIDTH)
    return placed.select(long("channel"), "event_id", long("cluster"))




def _parallel_seeds_sql(k_max: int) -> str:
    """k-means‖ over all vectors: two rounds of oversampling, weights, and the race among weighted candidates."""
    drawn = lambda step: UNIFORM_SQL.format(step=step).replace("vec_id)", "vec_id || ':0')")
    steps = [RECURSIVE_EMB, f"wanted AS (SELECT {GROUP_K} AS k FROM emb)", f"cand0 AS (SELECT 0 AS idx, x AS m FROM emb ORDER BY {drawn(0)}, vec_id LIMIT 1)"]
    for step in (1, 2):
        steps.append(f"near{step} AS (SELECT vec_id, any_value(x) AS x, min({D2.format(a='x', b='m')}) AS d2 FROM emb, cand{step - 1} GROUP BY vec_id)")
        steps.append(
            f"""cand{step} AS (SELECT * FROM cand{step - 1} UNION ALL
            SELECT (SELECT count(*) FROM cand{step - 1}) - 1 + row_number() OVER (ORDER BY vec_id), x FROM near{step}
            WHERE {drawn(step)} < 2 * (SELECT k FROM wanted) * d2 / (SELECT sum(d2) FROM near{step}))"""
        )
    steps.append(f"owner AS (SELECT vec_id, arg_min(idx, (d2, idx)) AS idx FROM (SELECT vec_id, idx, {D2.format(a='x', b='m')} AS d2 FROM emb, cand2) GROUP BY vec_id)")
    steps.append("weighed AS (SELECT cand2.idx, any_value(m) AS m, count(vec_id) AS w FROM cand2 LEFT JOIN owner ON owner.idx = cand2.idx GROUP BY cand2.idx)")
    raced = lambda step: UNIFORM_SQL.format(step=100 + step).replace("vec_id", "idx")
    steps.append(f"s0 AS (SELECT 0 AS g, 0 AS c, m FROM weighed WHERE w > 0 ORDER BY -ln({raced(0)}) / w, idx LIMIT 1)")
    for step in range(1, k_max):
        known = " UNION ALL ".join(f"SELECT m AS seed FROM s{i}" for i in range(step))
        steps.append(
            f"""s{step} AS (WITH known AS ({known}),
            away AS (SELECT idx, any_value(m) AS m, any_value(w) AS w, min({D2.format(a="m", b="seed")}) AS d2 FROM weighed, known GROUP BY idx)
            SELECT 0 AS g, {step} AS c, m FROM away, wanted WHERE w * d2 > 0 AND k > {step} ORDER BY -ln({raced(step)}) / (w * d2), idx LIMIT 1)"""
        )
    return ", ".join(steps) + ", seeds AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(k_max)) + ")"


POOLED_SEEDS_SQL = _parallel_seeds_sql(10)
POOLED_SQL = (
    _full_lloyd_sql(POOLED_SEEDS_SQL, "0") + "SELECT vec_id AS event_id, CAST(arg_min(c, (d2, c)) AS BIGINT) AS cluster FROM gaps GROUP BY vec_id"
)


@query("mlkm", POOLED_SQL)
def _mlkm(spark: SparkSession, folder: str) -> DataFrame:
    """All rounds, over the channels of an interval together."""
    return clusters.cluster_events(vectors(spark, folder), "mlkm", WIDTH).select("event_id", long("cluster"))


@query("sklkm", POOLED_SQL)
def _sklkm(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.cluster_events(vectors(spark, folder), "sklkm", WIDTH).select("event_id", long("cluster"))


@query("sklgmm")
def _sklgmm(spark: SparkSession, folder: str) -> DataFrame:
    features = pca_features(vectors(spark, folder), 10, column="x")
    return clusters.cluster_events(features, "sklgmm", 10).select("event_id", "cluster")


@query("gmm")
def _gmm(spark: SparkSession, folder: str) -> DataFrame:
    features = pca_features(vectors(spark, folder, F.col("label")), 10, column="x")
    return clusters.cluster_events(features, "gmm", 10).select("channel", "event_id", "cluster")


@query(
    "gmm_moments",
    EMB_SQL + ", d AS (SELECT unnest(range(64)) AS i) SELECT label, i, round(avg(x[i + 1]), 6) + 0.0 AS mean, true AS whole FROM emb, d GROUP BY ALL",
)
def _gmm_moments(spark: SparkSession, folder: str) -> DataFrame:
    """After a maximisation step a mixture's weights add up to 1, and its mean is the mean of the data."""
    points = spread(vectors(spark, folder, F.col("label")), KEYS)
    _, parameters = mixture.gaussian_mixture(points, F.lit(3), 3, WIDTH)
    whole = F.abs(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w) - 1) < 1e-9
    cells = parameters.select("channel", "weights", whole.alias("whole"), F.posexplode("means").alias("_p", "m"))
    share = F.get("weights", F.floor(F.col("_p") / WIDTH).cast("int")) * F.col("m")
    means = cells.groupBy(F.col("channel").alias("label"), (F.col("_p") % WIDTH).cast("bigint").alias("i"), "whole").agg(F.sum(share).alias("m"))
    return means.select("label", "i", rounded("m", 6).alias("mean"), "whole")


@query(
    "gmm_e_step",
    EMB_SQL
    + """, d AS (SELECT unnest(range(1, 65)) AS i),
    v AS (SELECT i, var_samp(x[i]) + 2e-6 AS s FROM emb, d GROUP BY i),
    m AS (SELECT vec_id AS c, x AS m FROM emb WHERE vec_id < 3),
    l AS (SELECT emb.vec_id, c, exp(sum(-0.5 * ((x[i] - m[i]) * (x[i] - m[i]) / s + ln(s)))) AS p
          FROM emb, m, v GROUP BY ALL)
    SELECT vec_id, c AS component, round(p / sum(p) OVER (PARTITION BY vec_id), 6) + 0.0 AS share FROM l""",
)
def _gmm_e_step(spark: SparkSession, folder: str) -> DataFrame:
    points = vectors(spark, folder)
    row_bytes = mixture.parameter_bytes(3, WIDTH)
    chunks = spread(points, KEYS).chunks(["x"], row_bytes)
    parameters = mixture.start(chunks, given_centers(points, 3), row_bytes)
    shares = mixture.responsibilities(chunks, parameters, row_bytes)
    cells = shares.select(F.col("event_id").alias("vec_id"), F.posexplode("shares").alias("component", "share"))
    return cells.select("vec_id", long("component"), rounded("share", 6).alias("share"))


# ---------------------------------------------------------------- clusters, units

SUMMARY_SQL = EMB_SQL + """,
cells AS (SELECT label AS channel, vec_id % 3 AS cluster, i, sum(x[i + 1]) AS total, count(*) AS n
          FROM emb, (SELECT unnest(range(64)) AS i) GROUP BY ALL),
summary AS (SELECT channel, cluster, any_value(n) AS n, list(total ORDER BY i) AS total,
                   row_number() OVER (ORDER BY channel, cluster) - 1 AS ord FROM cells GROUP BY channel, cluster),
centers AS (SELECT ord, channel, n, list_transform(total, lambda v: v / n) AS m FROM summary)
"""
PAIR_SQL = SUMMARY_SQL + f""",
pairs AS (SELECT a.ord AS a_ord, b.ord AS b_ord, sqrt({D2.format(a="a.m", b="b.m")}) AS distance
          FROM centers a, centers b WHERE a.ord < b.ord AND b.channel - a.channel <= 8)
"""


def thirds(spark: SparkSession, folder: str) -> DataFrame:
    """Each label's vectors in three clusters by id."""
    return vectors(spark, folder, F.col("label")).withColumn("cluster", (F.col("event_id") % 3).cast("int"))


def third_summary(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(clusters.cluster_summary(thirds(spark, folder), WIDTH))


@query(
    "cluster_summary",
    SUMMARY_SQL
    + """SELECT ord, s.channel, s.cluster, s.n, i, round(cells.total, 6) + 0.0 AS total FROM summary s
    JOIN cells ON cells.channel = s.channel AND cells.cluster = s.cluster""",
)
def _cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    cells = third_summary(spark, folder).select("ord", "channel", long("cluster"), "n", F.posexplode("sum").alias("i", "total"))
    return cells.select("ord", "channel", "cluster", "n", long("i"), rounded("total", 6).alias("total"))


@query(
    "cluster_members",
    "SELECT label AS channel, vec_id % 3 AS cluster, count(*) AS members, sum(vec_id) AS id_sum FROM embeddings GROUP BY ALL",
)
def _cluster_members(spark: SparkSession, folder: str) -> DataFrame:
    pieces = clusters.cluster_members(thirds(spark, folder))
    flat = pieces.select("channel", long("cluster"), F.explode("members").alias("m"))
    return flat.groupBy("channel", "cluster").agg(F.count("m").alias("members"), F.sum("m").alias("id_sum"))


@query(
    "small_channels",
    """WITH g AS (SELECT vec_id % 200 AS channel, vec_id, count(*) OVER (PARTITION BY vec_id % 200) AS n,
                     row_number() OVER (PARTITION BY vec_id % 200 ORDER BY vec_id) - 1 AS cluster FROM embeddings)
    SELECT channel, vec_id, cluster FROM g WHERE n <= 3""",
)
def _small_channels(spark: SparkSession, folder: str) -> DataFrame:
    points = spread(vectors(spark, folder, F.col("vec_id") % 200), KEYS)
    return clusters.bypass_small(points).select(long("channel"), F.col("event_id").alias("vec_id"), long("cluster"))


@query("vicinity_pairs", PAIR_SQL + "SELECT a_ord, b_ord, round(distance, 6) + 0.0 AS distance FROM pairs")
def _vicinity_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = merge.vicinity_pairs(third_summary(spark, folder))
    return pairs.select("a_ord", "b_ord", rounded("distance", 6).alias("distance"))


@query(
    "nearest_earlier",
    PAIR_SQL
    + """SELECT b_ord, a_ord, round(distance, 6) + 0.0 AS distance FROM pairs WHERE distance < 2
    QUALIFY row_number() OVER (PARTITION BY b_ord ORDER BY distance, a_ord DESC) = 1""",
)
def _nearest_earlier(spark: SparkSession, folder: str) -> DataFrame:
    best = merge.nearest_earlier(merge.vicinity_pairs(third_summary(spark, folder)))
    return best.select("b_ord", "a_ord", rounded("distance", 6).alias("distance"))


@query(
    "merge_mutual_round",
    PAIR_SQL
    + """, both_ways AS (SELECT a_ord AS ord, b_ord AS partner, distance FROM pairs WHERE distance < 2
                   UNION ALL SELECT b_ord, a_ord, distance FROM pairs WHERE distance < 2),
    best AS (SELECT ord, arg_min(partner, (distance, partner)) AS partner FROM both_ways GROUP BY ord)
    SELECT p.ord, p.partner AS unit FROM best p JOIN best q ON q.ord = p.partner AND q.partner = p.ord WHERE p.partner < p.ord""",
)
def _merge_mutual_round(spark: SparkSession, folder: str) -> DataFrame:
    pairs = materialize(merge.vicinity_pairs(third_summary(spark, folder)))
    return merge.mutual_partners(pairs).select("ord", "unit")


MERGE_ROUNDS = 40
MERGE_SQL = (
    PAIR_SQL.replace("WITH emb", "WITH RECURSIVE emb", 1)
    + f""", state AS (
      SELECT 0 AS round, ord, n, total, channel AS s, channel AS e, [ord] AS members FROM summary
      UNION ALL
      (WITH cur AS (SELECT * FROM state WHERE round < {MERGE_ROUNDS}),
      means AS (SELECT ord, s, e, list_transform(total, lambda v: v / n) AS m FROM cur),
      near AS (SELECT a.ord AS a, b.ord AS b, sqrt({D2.format(a="a.m", b="b.m")}) AS distance
               FROM means a, means b WHERE a.ord < b.ord AND b.e - a.s <= 8),
      both_ways AS (SELECT a AS ord, b AS partner, distance FROM near WHERE distance < 0.3
                    UNION ALL SELECT b, a, distance FROM near WHERE distance < 0.3),
      best AS (SELECT ord, arg_min(partner, (distance, partner)) AS partner FROM both_ways GROUP BY ord),
      joined AS (SELECT p.ord, p.partner AS unit FROM best p JOIN best q ON q.ord = p.partner AND q.partner = p.ord WHERE p.partner < p.ord),
      moved AS (SELECT round, coalesce(unit, cur.ord) AS ord, n, total, s, e, members FROM cur LEFT JOIN joined ON joined.ord = cur.ord),
      packed AS (SELECT round, ord, sum(n) AS n, list(total ORDER BY s) AS totals, min(s) AS s, max(e) AS e, flatten(list(members)) AS members
                 FROM moved GROUP BY round, ord)
      SELECT round + 1, ord, n, list_transform(range(1, 65), lambda i: list_sum(list_transform(totals, lambda t: t[i]))), s, e, members FROM packed)
    )"""
)


@query("merge_mutual", MERGE_SQL + f"SELECT unnest(members) AS ord, ord AS unit FROM state WHERE round = {MERGE_ROUNDS}")
def _merge_mutual(spark: SparkSession, folder: str) -> DataFrame:
    return merge.merge_mutual(third_summary(spark, folder), similarity=0.3).select("ord", "unit")


@query("merge_greedy")
def _merge_greedy(spark: SparkSession, folder: str) -> DataFrame:
    return merge.merge_greedy(third_summary(spark, folder), similarity=0.6).select("ord", "unit")


@query(
    "robust_distance",
    EMB_SQL
    + f""", cells AS (SELECT label, i, median(x[i]) AS v FROM emb, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
    med AS (SELECT label, list(v ORDER BY i) AS m FROM cells GROUP BY label),
    lines AS (SELECT a.label AS a, b.label AS b, list_transform(range(1, 65), lambda i: a.m[i] - b.m[i]) AS line
              FROM med a, med b WHERE a.label < b.label AND b.label - a.label <= 8),
    shadows AS (SELECT a, b, label, {DOT.format(a="x", b="line")} AS p FROM lines JOIN emb ON label = a OR label = b),
    mids AS (SELECT a, b, label, median(p) AS mid FROM shadows GROUP BY ALL),
    mads AS (SELECT a, b, label, median(abs(p - mid)) AS mad FROM shadows JOIN mids USING (a, b, label) GROUP BY ALL),
    widths AS (SELECT a, b, sqrt(sum(mad * mad)) AS width FROM mads GROUP BY ALL)
    SELECT CAST(a AS BIGINT) AS a_ord, CAST(b AS BIGINT) AS b_ord, round(sqrt({DOT.format(a="line", b="line")}) / width, 6) + 0.0 AS separation
    FROM lines JOIN widths USING (a, b)""",
)
def _robust_distance(spark: SparkSession, folder: str) -> DataFrame:
    assigned = vectors(spark, folder, F.col("label")).withColumn("cluster", F.lit(0))
    summary = materialize(clusters.cluster_summary(assigned, WIDTH))
    pairs = merge.vicinity_pairs(summary)
    members = assigned.withColumn("ord", F.col("channel").cast("bigint"))
    found = merge.robust_separation(members, pairs, rows_per_chunk=64)
    return found.select("a_ord", "b_ord", rounded("separation", 6).alias("separation"))


@query(
    "median_mad",
    """WITH middle AS (SELECT l_returnflag, median(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag)
    SELECT l_returnflag, round(any_value(m), 4) + 0.0 AS middle, round(median(abs(l_extendedprice - m)), 4) + 0.0 AS deviation
    FROM lineitem JOIN middle USING (l_returnflag) GROUP BY l_returnflag""",
)
def _median_mad(spark: SparkSession, folder: str) -> DataFrame:
    """Medians and median deviations of large groups: no group is sorted."""
    prices = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_returnflag", "l_extendedprice")
    middle = materialize(exact_median(prices, ["l_returnflag"], "l_extendedprice", "_m"))
    away = checked_join(prices, middle, ["l_returnflag"], rows=middle.count()).select("l_returnflag", F.abs(F.col("l_extendedprice") - F.col("_m")).alias("_away"))
    found = exact_median(away, ["l_returnflag"], "_away", "_d").join(middle, "l_returnflag")
    return found.select("l_returnflag", rounded("_m", 4).alias("middle"), rounded("_d", 4).alias("deviation"))


SUPPORT = 0.1


def label_units(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every label as one cluster that stays its own unit."""
    assigned = vectors(spark, folder, F.col("label")).withColumn("cluster", F.lit(0))
    summary = materialize(clusters.cluster_summary(assigned, WIDTH))
    merged = summary.withColumn("unit", F.col("ord").cast("bigint"))
    return assigned, merged, merge.unit_table(merged, SUPPORT)


UNIT_SQL = """WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
u AS (SELECT label AS channel, n, row_number() OVER (ORDER BY label) - 1 AS unit, n >= 0.1::DOUBLE * sum(n) OVER () AS kept FROM n)
"""


@query("min_support", UNIT_SQL + "SELECT vec_id, unit, unit AS label FROM embeddings e JOIN u ON u.channel = e.label WHERE kept")
def _min_support(spark: SparkSession, folder: str) -> DataFrame:
    assigned, merged, units = label_units(spark, folder)
    kept = merge.label_events(assigned.drop("label"), merged, units).filter("kept")
    return kept.select(F.col("event_id").alias("vec_id"), "unit", long("label"))


@query("thrown_events", UNIT_SQL + "SELECT vec_id, unit FROM embeddings e JOIN u ON u.channel = e.label WHERE NOT kept")
def _thrown_events(spark: SparkSession, folder: str) -> DataFrame:
    assigned, merged, units = label_units(spark, folder)
    thrown = merge.label_events(assigned.drop("label"), merged, units).filter("not kept")
    return thrown.select(F.col("event_id").alias("vec_id"), "unit")


@query(
    "run_report",
    UNIT_SQL
    + """SELECT sum(n)::BIGINT AS events, count(*) AS clusters, count(*) AS units, count(*) FILTER (kept) AS kept_units,
    coalesce(sum(n) FILTER (kept), 0)::BIGINT AS kept_events, coalesce(sum(n) FILTER (NOT kept), 0)::BIGINT AS thrown_events, sum(n)::BIGINT AS found_events, 0::BIGINT AS dropped_events FROM u""",
)
def _run_report(spark: SparkSession, folder: str) -> DataFrame:
    _, merged, units = label_units(spark, folder)
    return run_report(merged, units).drop("recording", "interval_id")


# ---------------------------------------------------------------- classifier


def _descent_sql(steps: int, rate: str, batches: str = "", in_batch: str = "true") -> str:
    """Unrolled gradient steps; ``losses`` holds the loss of the weights before the last step."""
    parts = [EMB_SQL + batches, "labels AS (SELECT DISTINCT label AS c FROM emb)", "n AS (SELECT count(*) AS n FROM emb)"]
    parts.append("w0 AS (SELECT c, list_transform(range(64), lambda i: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS b FROM labels)")
    source = "emb JOIN batches USING (vec_id)" if batches else "emb"
    for t in range(steps):
        parts.append(
            f"""m{t} AS (SELECT c, x, w, b, CASE WHEN label = c THEN 1.0::DOUBLE ELSE -1.0 END AS y,
            {in_batch.format(t=t)} AS inside, {DOT.format(a="w", b="x")} + b AS s FROM {source}, w{t})"""
        )
        parts.append(
            f"""g{t} AS (SELECT c, i, sum(CASE WHEN inside AND y * s < 1 THEN -y * x[i] ELSE 0 END) AS gw,
            sum(CASE WHEN inside AND y * s < 1 THEN -y ELSE 0 END) AS gb, sum(greatest(0, 1 - y * s)) AS hinge
            FROM m{t}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)"""
        )
        parts.append(
            f"""w{t + 1} AS (SELECT c, list(w[i] - {rate} * (w[i] + 100 * gw) ORDER BY i) AS w,
            any_value(b - {rate} * 100 * gb) AS b, any_value(0.5 * {DOT.format(a="w", b="w").replace("lambda i", "lambda q").replace("[i]", "[q]")} + 100 * hinge) AS loss
            FROM w{t} JOIN g{t} USING (c) GROUP BY c)"""
        )
    return ", ".join(parts) + f"""
    SELECT c AS label, i, round(w[i + 1], 10) + 0.0 AS w, round(b, 10) + 0.0 AS b, round(loss, 5) + 0.0 AS loss
    FROM w{steps}, (SELECT unnest(range(64)) AS i)"""


def model_cells(models: DataFrame) -> DataFrame:
    cells = models.select("label", "b", "loss", F.posexplode("w").alias("i", "w"))
    return cells.select("label", long("i"), rounded("w", 10).alias("w"), rounded("b", 10).alias("b"), rounded("loss", 5).alias("loss"))


@query("svm_bgd_steps", _descent_sql(3, "3e-7"))
def _svm_bgd_steps(spark: SparkSession, folder: str) -> DataFrame:
    return model_cells(svm.fit_svm(vectors(spark, folder).drop("channel"), "BGD", WIDTH, fixed_steps=3))


BATCH_SQL = f""", placed AS (SELECT vec_id, row_number() OVER (ORDER BY {UNIFORM_SQL.format(step=0)}, vec_id) - 1 AS place FROM emb),
batches AS (SELECT vec_id, place // {{size}} AS batch, CAST(ceil(count(*) OVER () / {{size}}.0) AS BIGINT) AS batches FROM placed)"""


@query("svm_mbgd_steps", _descent_sql(3, "1e-5", BATCH_SQL.format(size=20), "batch = {t} % batches"))
def _svm_mbgd_steps(spark: SparkSession, folder: str) -> DataFrame:
    return model_cells(svm.fit_svm(vectors(spark, folder).drop("channel"), "MBGD", WIDTH, fixed_steps=3))


@query("svm_sgd_steps", _descent_sql(3, "1e-4", BATCH_SQL.format(size=1), "batch = {t} % batches"))
def _svm_sgd_steps(spark: SparkSession, folder: str) -> DataFrame:
    return model_cells(svm.fit_svm(vectors(spark, folder).drop("channel"), "SGD", WIDTH, fixed_steps=3))


@query("mini_batches", EMB_SQL + BATCH_SQL.format(size=20) + "SELECT vec_id, batch, batches FROM batches")
def _mini_batches(spark: SparkSession, folder: str) -> DataFrame:
    placed = svm.with_batches(vectors(spark, folder).drop("channel"), svm.SCOPE, 20, 1)
    return placed.select(F.col("event_id").alias("vec_id"), "batch", "batches")


MEAN_MODEL_SQL = EMB_SQL + """,
cells AS (SELECT label AS c, i, avg(x[i]) AS v FROM emb, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
models AS (SELECT c, list(v ORDER BY i) AS w FROM cells GROUP BY c)
"""


def mean_models(points: DataFrame) -> DataFrame:
    """A model per label: the mean of its vectors as weights, no offset."""
    labelled = points.withColumn("cluster", F.lit(0)).withColumn("channel", F.col("label"))
    summary = clusters.cluster_summary(labelled, WIDTH)
    return summary.select(*svm.SCOPE, F.col("channel").alias("label"), merge.centroid(F.col("sum"), F.col("n")).alias("w"), F.lit(0.0).alias("b"))


@query(
    "svm_predict",
    MEAN_MODEL_SQL
    + f""", scores AS (SELECT vec_id, c, {DOT.format(a="w", b="x")} AS s FROM emb, models)
    SELECT vec_id, arg_min(c, (-s, c)) AS predicted, round(max(s), 6) + 0.0 AS score FROM scores GROUP BY vec_id
    UNION ALL SELECT vec_id, NULL, NULL FROM emb WHERE vec_id < 50""",
)
def _svm_predict(spark: SparkSession, folder: str) -> DataFrame:
    points = vectors(spark, folder)
    other = points.filter("event_id < 50").withColumn("interval_id", F.col("interval_id") + 1)  # an interval without a model
    scored = svm.predict(points.unionByName(other).drop("label"), materialize(mean_models(points)), width=WIDTH)
    return scored.select(F.col("event_id").alias("vec_id"), "predicted", rounded("score", 6).alias("score"))


@query(
    "hinge_loss",
    MEAN_MODEL_SQL
    + f""", s AS (SELECT c, w, CASE WHEN label = c THEN 1.0::DOUBLE ELSE -1.0 END * {DOT.format(a="w", b="x")} AS margin FROM emb, models)
    SELECT c AS label, round(any_value(0.5 * {DOT.format(a="w", b="w")}) + 100 * sum(greatest(0, 1 - margin)), 4) + 0.0 AS loss
    FROM s GROUP BY c""",
)
def _hinge_loss(spark: SparkSession, folder: str) -> DataFrame:
    points = vectors(spark, folder)
    losses = svm.svm_loss(points, materialize(mean_models(points)), WIDTH)
    return losses.select("label", rounded("loss", 4).alias("loss"))


SVM_BGD_SQL = (
    RECURSIVE_EMB
    + f""", labels AS (SELECT DISTINCT label AS c FROM emb),
    walk AS (
      SELECT c, list_transform(range(64), lambda i: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS b, NULL::DOUBLE AS loss, false AS done, 0::BIGINT AS steps, 0 AS round FROM labels
      UNION ALL
      (WITH cur AS (SELECT * FROM walk WHERE (SELECT bool_or(NOT done) FROM walk)),
      m AS (SELECT c, x, CASE WHEN label = c THEN 1.0::DOUBLE ELSE -1.0 END AS y, {DOT.format(a="w", b="x")} + b AS s FROM emb, cur),
      h AS (SELECT c, sum(greatest(0, 1 - y * s)) AS hinge, coalesce(sum(-y) FILTER (y * s < 1), 0) AS gb FROM m GROUP BY c),
      cells AS (SELECT c, i, coalesce(sum(-y * x[i]) FILTER (y * s < 1), 0) AS v FROM m, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i),
      g AS (SELECT c, list(v ORDER BY i) AS gw FROM cells GROUP BY c),
      judged AS (SELECT cur.*, gb, gw, 0.5 * {DOT.format(a="w", b="w")} + 100 * hinge AS fresh
                 FROM cur JOIN h ON h.c = cur.c JOIN g ON g.c = cur.c),
      ended AS (SELECT *, done OR coalesce(abs(loss - fresh) / loss * 100 < 0.25, false) OR fresh = 0 AS stop FROM judged)
      SELECT c, CASE WHEN stop THEN w ELSE list_transform(range(1, 65), lambda i: w[i] - 3e-7::DOUBLE * (w[i] + 100 * gw[i])) END,
        CASE WHEN stop THEN b ELSE b - 3e-7::DOUBLE * 100 * gb END, CASE WHEN done THEN loss ELSE fresh END, stop, steps + CAST(NOT stop AS BIGINT), round + 1
      FROM ended)
    )
    SELECT c AS label, steps, done, i, round(w[i + 1], 8) + 0.0 AS w, round(b, 8) + 0.0 AS b, round(loss, 4) + 0.0 AS loss
    FROM walk, (SELECT unnest(range(64)) AS i) WHERE round = (SELECT max(round) FROM walk)"""
)


@query("svm_bgd", SVM_BGD_SQL)
def _svm_bgd(spark: SparkSession, folder: str) -> DataFrame:
    """Batch descent until every class has met the stop rule."""
    cells = svm.fit_svm(vectors(spark, folder), "BGD", WIDTH).select("label", "b", "loss", "done", long("steps"), F.posexplode("w").alias("i", "w"))
    return cells.select("label", "steps", "done", long("i"), rounded("w", 8).alias("w"), rounded("b", 8).alias("b"), rounded("loss", 4).alias("loss"))


@query("linear_svc")
def _linear_svc(spark: SparkSession, folder: str) -> DataFrame:
    return svm.library_svm(vectors(spark, folder))


@query("distinct_labels", "SELECT DISTINCT label FROM embeddings ORDER BY label")
def _distinct_labels(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).select("label").distinct().orderBy("label")


@query("scatter_2d")
def _scatter_2d(spark: SparkSession, folder: str) -> DataFrame:
    return scatter_2d(vectors(spark, folder)).select("event_id", "label", "px", "py")


# ---------------------------------------------------------------- the whole job


@query(
    "sort_series_events",
    WAVE_SQL
    + """, busy AS (SELECT channel FROM found GROUP BY channel HAVING count(*) >= 2)
    SELECT channel, count(*) AS events FROM spans JOIN busy USING (channel) WHERE span <> 0 GROUP BY channel""",
)
def _sort_series_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events per channel at the end of the whole job, kept and thrown."""
    return price_run(spark, folder).assigned.groupBy(long("channel")).agg(F.count(F.lit(1)).alias("events"))


FRAMES_SQL = """WITH placed AS (
  SELECT l_suppkey AS supplier, l_quantity AS q, l_discount AS d, l_tax AS t, l_linenumber AS l,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS frame FROM lineitem),
cells AS (
  SELECT supplier, frame, 0 AS channel, round(q)::BIGINT AS v FROM placed UNION ALL
  SELECT supplier, frame, 1, round(d * 100)::BIGINT FROM placed UNION ALL
  SELECT supplier, frame, 2, round(t * 100)::BIGINT FROM placed UNION ALL
  SELECT supplier, frame, 3, l::BIGINT FROM placed)
"""


def recorded(spark: SparkSession, folder: str) -> str:
    """``lineitem`` as one recording of four channels per supplier, in the checkpoint folder."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    cents = lines.withColumn("_d", F.col("l_discount") * 100).withColumn("_t", F.col("l_tax") * 100)
    root = checkpoint_folder(spark)
    root = root[5:] if root.startswith("file:") and "://" not in root else root
    path = f"{root}/recording-{uuid.uuid4().hex}"
    write_recording(cents, path, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], ["l_quantity", "_d", "_t", "l_linenumber"]).count()
    return path


def recorded_blocks(spark: SparkSession, folder: str, **options) -> DataFrame:
    blocks = read_recording(spark, recorded(spark, folder), channels=4, sample_hz=100, interval_s=2, block_len=64, lead=5, tail=5, **options)
    return blocks.withColumn("supplier", F.regexp_extract("recording", r"(\d+)\.bin$", 1).cast("bigint"))


@query(
    "recording_scan",
    FRAMES_SQL
    + """SELECT supplier, CAST(frame // 200 AS BIGINT) AS interval_id, CAST(channel AS BIGINT) AS channel, count(*) AS n,
    sum(v)::BIGINT AS total, sum(v * (frame % 200))::BIGINT AS placed FROM cells GROUP BY ALL""",
)
def _recording_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings written and scanned: every sample of every channel at its place in its interval."""
    cells = explode_blocks(recorded_blocks(spark, folder)).withColumn(
        "supplier", F.regexp_extract("recording", r"(\d+)\.bin$", 1).cast("bigint")
    )
    found = cells.groupBy("supplier", long("interval_id"), long("channel"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("bigint").alias("total"), F.sum(F.col("value") * F.col("sample")).cast("bigint").alias("placed"))


@query(
    "recording_blocks",
    FRAMES_SQL
    + """, sized AS (SELECT supplier, frame // 200 AS interval_id, count(*) AS n FROM placed GROUP BY ALL)
    SELECT supplier, CAST(interval_id AS BIGINT) AS interval_id, CAST(channel AS BIGINT) AS channel, CAST(block AS BIGINT) AS block,
      CAST(least(64, n - block * 64) AS BIGINT) AS n_core, CAST(least(n, block * 64 + 69) - greatest(0, block * 64 - 5) AS BIGINT) AS n_all
    FROM sized, (SELECT unnest(range(4)) AS channel), (SELECT unnest(range(4)) AS block) WHERE block * 64 < n""",
)
def _recording_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with their neighbours, cut off at the ends of an interval."""
    return recorded_blocks(spark, folder).select(
        "supplier", long("interval_id"), long("channel"), long("block"), long("n_core"), F.size("samples").cast("bigint").alias("n_all")
    )


@query("sink_round_trip", "SELECT vec_id, label FROM embeddings")
def _sink_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Stale intervals are committed first, then replaced by two runs, each of which leaves the other's alone."""
    path = f"{checkpoint_folder(spark)}/sink-{uuid.uuid4().hex}"
    whole = vectors(spark, folder).withColumn("interval_id", (F.col("event_id") % 4).cast("int"))
    commit_result(whole.withColumn("label", F.lit(-1)), path)
    for half in ("interval_id < 2", "interval_id >= 2"):
        commit_result(whole.filter(half), path)
    return read_result(spark, path).select(F.col("event_id").alias("vec_id"), "label")


def price_run(spark: SparkSession, folder: str) -> Sorted:
    return sort_blocks(
        price_blocks(spark, folder), window=WINDOW, factor=FACTOR, offset=OFFSET, max_threshold=LIMIT, minimal_support=0.0005, svm=None
    )


@query("sort_series")
def sort_series(spark: SparkSession, folder: str) -> DataFrame:
    """Series to labelled events, through every stage but the recording file."""
    done = price_run(spark, folder)
    return done.labelled.select("channel", "event_id", "cluster", "unit", "label")
