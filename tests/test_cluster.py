import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import cluster as C
from pulsegrid.operators import kmeans as KM
from pulsegrid.operators.mixture import gaussian_mixture, log_density
from pulsegrid.operators.moments import covariance, from_upper
from pulsegrid.operators.reduce import extract_features, library_pca, pca_features
from pulsegrid.plans import spread as plans
from pulsegrid.plans.spread import spread
from pulsegrid.session import KEYS

SCHEMA = "recording string, interval_id int, channel int, event_id bigint, x array<double>"


def table(spark, groups):
    rows = [("r", 0, c, i, [float(v) for v in x]) for c, xs in groups.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def clouds(seed=0, per=60, width=4, centers=3, gap=6.0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 1, (per, width)) + rng.normal(0, gap, width) for _ in range(centers)])


@pytest.fixture(params=["broadcast", "salted"])
def plan(request, monkeypatch):
    """Run with small parameter tables, and with every size check failing and every group hot."""
    if request.param == "salted":
        monkeypatch.setattr(plans, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(plans, "ROWS_PER_SALT", 25)
        monkeypatch.setattr(plans.spread, "__defaults__", (25,))
    return request.param


def test_spread_keeps_every_row_and_splits_hot_groups(spark, plan):
    groups = {0: clouds(), 1: clouds(1, per=1, centers=2), 2: clouds(2, per=5)}
    points = spread(table(spark, groups), KEYS)
    assert points.points.count() == points.total == 180 + 2 + 15
    salts = points.points.filter("channel = 0").select("salt").distinct().count()
    assert salts == (8 if plan == "salted" else 1)
    sized = points.attach(points.sizes.select(*KEYS, "n"))
    assert sorted(sized.groupBy("channel", "n").count().select("n", "count").collect()) == [(2, 2), (15, 15), (180, 180)]
    chunked = points.chunks(["x"], rows_per_chunk=16).points
    assert chunked.agg(F.sum(F.size("event_ids"))).first()[0] == 197
    assert chunked.filter("channel = 0").count() >= 8


def test_covariance(spark, plan):
    groups = {0: clouds() + 1000, 1: clouds(1, per=2, centers=1)}
    rows = covariance(spread(table(spark, groups), KEYS).chunks(["x"], rows_per_chunk=32).settle()).collect()
    assert len(rows) == 2
    for r in rows:
        x = groups[r.channel]
        assert np.allclose(r.mean, x.mean(axis=0))
        assert np.allclose(from_upper(np.array(r["cov"])), np.cov(x.T, bias=True), atol=1e-10)


def test_pca_per_channel(spark, plan):
    groups = {0: clouds(width=12), 1: clouds(5, width=12)}
    got = pca_features(table(spark, groups), 3, column="x").toPandas()
    for c, x in groups.items():
        mine = np.stack(got[got.channel == c].sort_values("event_id").x)
        values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
        expect = (x - x.mean(axis=0)) @ vectors[:, ::-1][:, :3]
        assert np.allclose(np.abs(mine), np.abs(expect), atol=1e-8)


def test_pca_pooled_and_library(spark):
    groups = {0: clouds(width=6), 1: clouds(5, width=6)}
    df = table(spark, groups)
    both = np.concatenate([groups[0], groups[1]])
    values, vectors = np.linalg.eigh(np.cov(both.T, bias=True))
    expect = (both - both.mean(axis=0)) @ vectors[:, ::-1][:, :2]
    pooled = pca_features(df, 2, basis="pooled", column="x").toPandas().sort_values(["channel", "event_id"])
    assert np.allclose(np.abs(np.stack(pooled.x)), np.abs(expect), atol=1e-8)
    library = extract_features(df, "MLPCA", 2, column="x").toPandas().sort_values(["channel", "event_id"])
    shifted = np.stack(library.x)
    assert np.allclose(np.abs(shifted - shifted.mean(axis=0)), np.abs(expect), atol=1e-6)
    with pytest.raises(ValueError):
        extract_features(df, "ica")
    with pytest.raises(ValueError):
        pca_features(df, basis="other")


def numpy_lloyd(x, centers, rounds):
    centers = centers.copy()
    for i in range(rounds):
        label = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        if i == rounds - 1:
            return label, centers
        for c in range(len(centers)):
            if (label == c).any():
                centers[c] = x[label == c].mean(axis=0)


def test_lloyd_matches_brute_force(spark, plan):
    groups = {0: clouds(gap=1.0), 1: clouds(1, per=20, gap=0.5)}
    points = spread(table(spark, groups), KEYS)
    start = [("r", 0, c, [*x[:3].reshape(-1).tolist(), *[99.0] * 4]) for c, x in groups.items()]
    centers = spark.createDataFrame(start, "recording string, interval_id int, channel int, centers array<double>")
    placed, used = KM.kmeans(points, F.lit(4), 4, 4, max_iter=6, centers=centers)
    got = placed.toPandas().sort_values(["channel", "event_id"])
    for c, x in groups.items():
        label, expect = numpy_lloyd(x, np.reshape(start[c][3], (4, 4)), 7)
        assert got[got.channel == c].cluster.tolist() == label.tolist()
        assert np.allclose(used.filter(F.col("channel") == c).first().centers, expect.reshape(-1))
    errors = KM.cluster_error(placed, KEYS).toPandas()
    assert errors.n.sum() == 240 and errors.wsse.sum() == pytest.approx(got.d2.sum())


def test_cost_never_rises(spark):
    points = spread(table(spark, {0: clouds(gap=1.0)}), KEYS)
    cost = [KM.kmeans(points, F.lit(3), 3, 4, max_iter=m)[0].agg(F.sum("d2")).first()[0] for m in (0, 1, 3)]
    assert cost == sorted(cost, reverse=True)


def test_seeds_do_not_depend_on_partitioning(spark, plan):
    df = table(spark, {0: clouds(), 1: clouds(1), 2: np.ones((9, 4))})
    found = []
    for parts in (1, 7):
        points = spread(df.repartition(parts), KEYS)
        seeds = KM.spread_out_seeds(points, points.chunks(["x"], 128), F.lit(3), 3, 128)
        found.append({r.channel: np.reshape(r.centers, (-1, 4)).tolist() for r in seeds.collect()})
        other = KM.random_seeds(points, F.lit(3), 3).collect()
        assert all(len(r.centers) == 12 for r in other)
    assert found[0] == found[1]
    assert [len(found[0][c]) for c in range(3)] == [3, 3, 1]
    assert len({tuple(s) for s in found[0][0]}) == 3


def test_parallel_seeds(spark):
    """Seeds are points, do not depend on partitioning, and lie in all clouds of a pooled interval."""
    df = table(spark, {0: clouds(gap=30.0), 1: clouds(1, gap=30.0), 2: np.ones((9, 4))}).withColumn("interval_id", (F.col("channel") == 2).cast("int"))
    rows = {tuple(r.x) for r in df.collect()}
    found = []
    for parts in (1, 7):
        points = spread(df.repartition(parts), KEYS)
        chunks = points.chunks(["x"], 128, rows_per_chunk=32).pooled(KEYS[:2]).settle()
        seeds = KM.parallel_seeds(chunks, F.lit(3), 3, 4)
        found.append({r.interval_id: np.reshape(r.centers, (-1, 4)).tolist() for r in seeds.collect()})
    assert found[0] == found[1] and len(found[0][0]) == 3 and found[0][1] == [[1.0] * 4]
    assert {tuple(s) for s in found[0][0]} <= rows
    cost = {}
    for init in ("parallel", "random"):
        placed, _ = KM.kmeans(spread(df.filter("interval_id = 0"), KEYS), F.lit(3), 3, 4, init=init, pool=KEYS[:2])
        cost[init] = placed.agg(F.sum("d2")).first()[0]
    assert cost["parallel"] <= cost["random"] * (1 + 1e-9)


def test_draws_are_proportional_to_squared_distance(spark):
    """Races over many seeds pick points 1 and 2 at squared distances 1 and 9 in that proportion."""
    points = spread(table(spark, {0: np.array([[0.0], [1.0], [3.0]])}), KEYS)
    zero = spark.createDataFrame([("r", 0, 0, 1, [[0.0]])], "recording string, interval_id int, channel int, _k int, centers array<array<double>>")
    from pulsegrid.functions.rules import uniform

    wins = []
    near = points.attach(zero).filter("event_id > 0")
    many = near.select("event_id", (F.element_at("x", 1) ** 2).alias("d2"), F.explode(F.sequence(F.lit(0), F.lit(3999))).alias("s"))
    u = uniform(1, 1, F.concat_ws("-", "s", "event_id"))
    wins = many.groupBy("s").agg(F.min_by("event_id", -F.ln(u) / F.col("d2")).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 4000 for r in wins}
    assert share[1] == pytest.approx(0.1, abs=0.02)


def test_methods_and_small_channels(spark):
    groups = {0: clouds(gap=20.0, per=40), 1: clouds(1, per=3, centers=1), 2: clouds(2, per=1, centers=2), 3: clouds(3, per=4, centers=1)}
    df = table(spark, groups)
    for method in ("km", "KM", "mlkm", "sklkm", "gmm", "sklgmm"):
        got = C.cluster_events(df, method, width=4).toPandas()
        assert len(got) == 120 + 3 + 2 + 4 and not got.duplicated(["channel", "event_id"]).any()
        big = got[got.channel == 0].sort_values("event_id").cluster.to_numpy().reshape(3, 40)
        if method not in ("mlkm", "sklkm", "sklgmm"):
            assert set(got[got.channel == 1].cluster) == {0, 1, 2} and set(got[got.channel == 2].cluster) == {0, 1}
        if method.lower() == "km":
            assert all(len(set(line)) == 1 for line in big) and len(set(big[:, 0])) == 3
    with pytest.raises(ValueError):
        C.cluster_events(df, "dbscan")
    empty = C.cluster_events(df.filter("channel > 99"), "km", width=4)
    assert empty.count() == 0


def test_mixture_matches_brute_force(spark, plan):
    x = clouds(gap=3.0)
    points = spread(table(spark, {0: x}), KEYS)
    labels, parameters = gaussian_mixture(points, F.lit(3), 3, 4, max_iter=4)
    seeds = np.reshape(KM.random_seeds(points, F.lit(3), 3).first().centers, (3, 4))
    ridge = 1e-6 * np.eye(4)
    weights, means = np.full(3, 1 / 3), seeds
    covs = np.stack([np.diag(np.cov(x.T).diagonal()) + ridge] * 3)
    for _ in range(5):
        density = np.exp(log_density(x, means, covs + ridge)) * weights
        share = density / density.sum(axis=1, keepdims=True)
        mass = share.sum(axis=0)
        weights, means = mass / len(x), share.T @ x / mass[:, None]
        covs = np.stack([(share[:, i, None] * (x - means[i])).T @ (x - means[i]) / mass[i] + ridge for i in range(3)])
    row = parameters.first()
    assert np.allclose(row.weights, weights, atol=1e-8)
    assert np.allclose(np.reshape(row.means, (3, 4)), means, atol=1e-7)
    assert np.allclose(np.reshape(row.covs, (3, 4, 4)), covs, atol=1e-7)
    got = labels.toPandas().sort_values("event_id").cluster.tolist()
    assert got == log_density(x, means, covs).argmax(axis=1).tolist()


def test_log_density_of_a_normal():
    x, mean, cov = np.array([[0.3, -1.0]]), np.array([[0.1, 0.2]]), np.array([[[2.0, 0.3], [0.3, 1.0]]])
    away = x[0] - mean[0]
    direct = -0.5 * (away @ np.linalg.inv(cov[0]) @ away + np.log(np.linalg.det(2 * np.pi * cov[0])))
    assert log_density(x, mean, cov)[0, 0] == pytest.approx(direct)


def test_summary_and_members(spark):
    groups = {0: clouds(per=4, width=2), 3: clouds(1, per=2, width=2)}
    assigned = table(spark, groups).withColumn("cluster", (F.col("event_id") % 2).cast("int"))
    rows = C.cluster_summary(assigned, 2).orderBy("ord").collect()
    assert [(r.ord, r.channel, r.cluster, r.n, r.s_chn, r.e_chn) for r in rows] == [
        (0, 0, 0, 6, 0, 0), (1, 0, 1, 6, 0, 0), (2, 3, 0, 3, 3, 3), (3, 3, 1, 3, 3, 3)
    ]
    assert np.allclose(rows[0]["sum"], groups[0][::2].sum(axis=0))
    members = C.cluster_members(assigned, piece=2).groupBy("channel", "cluster").agg(F.sum(F.size("members")).alias("n"))
    assert sorted(r.n for r in members.collect()) == [3, 3, 6, 6]


def test_more_than_ten_clusters(spark):
    points = spread(table(spark, {0: clouds()}), KEYS)
    seeds = np.reshape(KM.random_seeds(points, F.lit(15), 15).first().centers, (-1, 4))
    assert len({tuple(s) for s in seeds}) == 15
    found = C.cluster_events(table(spark, {0: clouds()}), "gmm", width=4, k=15)
    assert found.agg(F.max("cluster")).first()[0] > 10


@pytest.mark.parametrize("method", ["km", "mlkm", "sklkm", "gmm", "sklgmm"])
def test_another_interval_changes_no_clusters(spark, method):
    first = table(spark, {0: clouds(), 1: clouds(5)})
    second = table(spark, {0: clouds(7) * 3, 4: clouds(9)}).withColumn("interval_id", F.lit(1))
    labels = lambda df: sorted(C.cluster_events(df, method, width=4, k=4).filter("interval_id = 0").select("channel", "event_id", "cluster").collect())
    alone = labels(first)
    assert len(alone) == first.count() and labels(first.unionByName(second)) == alone


@pytest.mark.parametrize("method, options", [("pca", {}), ("pca", {"basis": "pooled"}), ("mlpca", {})])
def test_another_interval_changes_no_features(spark, method, options):
    first = table(spark, {0: clouds(width=6), 1: clouds(5, width=6)})
    second = table(spark, {0: clouds(7, width=6) * 3}).withColumn("interval_id", F.lit(1))
    found = lambda df: np.stack(extract_features(df, method, 2, column="x", **options).filter("interval_id = 0").toPandas().sort_values(["channel", "event_id"]).x)
    assert np.allclose(found(first), found(first.unionByName(second)), atol=1e-9)


def test_library_models_refuse_several_intervals(spark):
    both = table(spark, {0: clouds()}).unionByName(table(spark, {0: clouds(1)}).withColumn("interval_id", F.lit(1)))
    with pytest.raises(ValueError, match="one interval"):
        library_pca(both, 2, "x")


def test_small_groups_are_clustered_in_one_pass(spark, plan, monkeypatch):
    groups = {0: clouds(gap=1.0), 1: clouds(1, per=20, gap=0.5), 2: np.ones((9, 4)), 3: clouds(2, per=500)}
    points = spread(table(spark, groups), KEYS)
    k = F.when(F.col("n") < 100, 2).otherwise(4)
    placed, used = KM.kmeans(points, k, 4, 4)
    got = placed.toPandas().sort_values(["channel", "event_id"]), used.toPandas().sort_values("channel")
    monkeypatch.setattr(plans.Spread, "by_rows", lambda self, rows_per_chunk=1024: (self.with_points(self.points.limit(0)), self))
    placed, used = KM.kmeans(points, k, 4, 4)
    rounds = placed.toPandas().sort_values(["channel", "event_id"]), used.toPandas().sort_values("channel")
    assert got[0].cluster.tolist() == rounds[0].cluster.tolist() and got[0].d2.tolist() == pytest.approx(rounds[0].d2.tolist())
    assert np.allclose(np.concatenate(got[1].centers.tolist()), np.concatenate(rounds[1].centers.tolist()))


def test_small_groups_need_no_rounds(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a round over all groups")

    monkeypatch.setattr(KM, "move_centers", refuse)
    placed, _ = KM.kmeans(spread(table(spark, {0: clouds(), 1: clouds(1)}), KEYS), F.lit(3), 3, 4)
    assert placed.count() == 360


def test_small_groups_get_their_basis_where_they_are_projected(spark, monkeypatch):
    waves = table(spark, {0: clouds(per=3), 1: clouds(1, per=40)}).withColumnRenamed("x", "wave")
    mixed = pca_features(waves, 3, rows_per_chunk=32).toPandas().sort_values(["channel", "event_id"])
    monkeypatch.setattr("pulsegrid.operators.reduce.covariance", None)
    whole = pca_features(waves, 3).toPandas().sort_values(["channel", "event_id"])
    assert np.allclose(np.stack(mixed.x), np.stack(whole.x))
