import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cluster import clouds

from pulsegrid.operators import merge as M
from pulsegrid.operators import svm as S
from pulsegrid.operators.report import check_conservation, run_report, scatter_2d
from pulsegrid.plans import spread as plans

SUMMARY = "recording string, interval_id int, channel int, cluster int, ord bigint, n bigint, sum array<double>, s_chn int, e_chn int"


def summary_rows(rng, channels, per=3, width=2, size=4.0):
    rows = []
    for c in channels:
        for k in range(per):
            n = int(rng.integers(1, 40))
            rows.append((c, k, len(rows), n, (rng.normal(0, size, width) * n).tolist()))
    return rows


def summary_table(spark, rows, interval=0):
    return spark.createDataFrame([("r", interval, c, k, o, n, s, c, c) for c, k, o, n, s in rows], SUMMARY).repartition(3)


def merge_by_rule(rows, vicinity=8, similarity=2.0, passes=8, strict=False):
    """The written rule on plain lists: {ord: founding ord}."""
    units = [{"ords": [o], "n": n, "sum": np.array(s), "start": c, "end": c} for c, _, o, n, s in rows]
    for _ in range(passes):
        done = []
        for new in units:
            best, gap = None, None
            for old in reversed(done):
                if new["end"] - old["start"] > vicinity:
                    break
                d = np.linalg.norm(old["sum"] / old["n"] - new["sum"] / new["n"])
                if d < similarity and (best is None or d < gap):
                    best, gap = old, d
            if best is None:
                done.append(dict(new, ords=list(new["ords"]), sum=new["sum"].copy()))
            else:
                best["ords"] += new["ords"]
                best["n"] += new["n"]
                best["sum"] = best["sum"] + new["sum"]
                best["end"] = max(best["end"], new["end"]) if strict else new["end"]
        same = len(done) == len(units)
        units = done
        if same:
            break
    return {o: u["ords"][0] for u in units for o in u["ords"]}


@pytest.mark.parametrize("channels", [range(20), [0, 1, 4, 12, 13, 30, 31, 39, 48, 60]])
@pytest.mark.parametrize("strict", [False, True])
def test_greedy_merge_matches_the_rule(spark, channels, strict):
    rng = np.random.default_rng(4)
    tables, expect = None, {}
    for interval in range(3):
        rows = summary_rows(rng, channels)
        part = summary_table(spark, rows, interval)
        tables = part if tables is None else tables.union(part)
        expect.update({(interval, o): u for o, u in merge_by_rule(rows, strict=strict).items()})
    got = {(r.interval_id, r.ord): r.unit for r in M.merge_greedy(tables, strict_span=strict).collect()}
    assert got == expect and len({(i, u) for (i, _), u in got.items()}) < len(channels) * 9


def test_islands_and_limits(spark):
    rows = summary_rows(np.random.default_rng(0), [0, 8, 17, 18, 30], per=1)
    table = summary_table(spark, rows)
    assert [r.island for r in M.islands(table).orderBy("ord").collect()] == [1, 1, 2, 2, 3]
    with pytest.raises(ValueError, match="mutual"):
        M.merge_greedy(table, island_limit=1)
    with pytest.raises(ValueError):
        M.merge_clusters(table, "other")
    assert M.merge_greedy(table.filter("ord < 0")).count() == 0


def test_pairs_and_nearest(spark):
    rows = summary_rows(np.random.default_rng(1), range(0, 40, 2))
    got = {(r.a_ord, r.b_ord): r.distance for r in M.vicinity_pairs(summary_table(spark, rows)).collect()}
    expect = {
        (a[2], b[2]): np.linalg.norm(np.array(a[4]) / a[3] - np.array(b[4]) / b[3])
        for a in rows
        for b in rows
        if a[2] < b[2] and b[0] - a[0] <= 8
    }
    assert got.keys() == expect.keys() and all(got[k] == pytest.approx(expect[k]) for k in got)
    near = {r.b_ord: r.a_ord for r in M.nearest_earlier(M.vicinity_pairs(summary_table(spark, rows))).collect()}
    for b, a in near.items():
        close = {p: d for (p, q), d in expect.items() if q == b and d < 2}
        assert close[a] == min(close.values())


@pytest.mark.parametrize("limit", [50_000, 20])
def test_mutual_merge(spark, limit):
    rows = summary_rows(np.random.default_rng(2), [*range(12), *range(30, 34)], size=1.5)
    table = summary_table(spark, rows)
    units = {r.ord: r.unit for r in M.merge_mutual(table, island_limit=limit).collect()}
    state = {o: [n, np.array(s), c, c] for c, _, o, n, s in rows}
    expect = {o: o for o in state}
    while True:
        near = {}
        for a in state:
            for b in state:
                if a < b and state[b][3] - state[a][2] <= 8:
                    d = np.linalg.norm(state[a][1] / state[a][0] - state[b][1] / state[b][0])
                    if d < 2:
                        near.setdefault(a, []).append((d, b))
                        near.setdefault(b, []).append((d, a))
        best = {o: min(c)[1] for o, c in near.items()}
        pairs = [(o, p) for o, p in best.items() if o < p and best[p] == o]
        if not pairs:
            break
        for a, b in pairs:
            n, s, lo, hi = state.pop(b)
            state[a] = [state[a][0] + n, state[a][1] + s, min(state[a][2], lo), max(state[a][3], hi)]
            expect = {o: a if u == b else u for o, u in expect.items()}
    assert units == expect and len(state) < 48


@pytest.mark.parametrize("rows_per_chunk,limit", [(1024, 1_000_000), (8, 1_000_000), (35, 3)])
def test_robust_separation(spark, rows_per_chunk, limit):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(0, 1, (41, 3)), 1: rng.normal(2, 1, (30, 3)), 2: rng.normal(-1, 2, (1, 3))}
    rows = [("r", 0, o, o * 1000 + i, x.tolist()) for o, xs in groups.items() for i, x in enumerate(xs)]
    assigned = spark.createDataFrame(rows, "recording string, interval_id int, ord bigint, event_id bigint, x array<double>")
    pairs = spark.createDataFrame([("r", 0, a, b) for a, b in [(0, 1), (0, 2), (1, 2)]], "recording string, interval_id int, a_ord bigint, b_ord bigint")
    for r in M.robust_separation(assigned, pairs, rows_per_chunk, limit).collect():
        line = np.median(groups[r.a_ord], axis=0) - np.median(groups[r.b_ord], axis=0)
        mad = [np.median(np.abs(p - np.median(p))) for p in (groups[r.a_ord] @ line, groups[r.b_ord] @ line)]
        assert r.separation == pytest.approx(np.linalg.norm(line) / np.hypot(*mad))


def test_support_labels_and_report(spark, monkeypatch):
    rows = [(0, 0, 0, 600, [0.0]), (1, 0, 1, 2, [500.0]), (1, 1, 2, 300, [30000.0]), (2, 0, 3, 98, [0.0])]
    summary = summary_table(spark, rows)
    merged = M.merge_clusters(summary)
    units = M.unit_table(merged).orderBy("unit").collect()
    assert [(u.unit, u.n, u.clusters, u.s_chn, u.e_chn, u.label, u.kept) for u in units] == [
        (0, 698, 2, 0, 2, 0, True), (1, 2, 1, 1, 1, 1, False), (2, 300, 1, 1, 1, 2, True)
    ]
    dense = {u.unit: u.label for u in M.unit_table(merged, dense=True).collect()}
    assert dense == {0: 0, 1: None, 2: 1}
    events = [("r", 0, c, i, [s[0] / n], k) for c, k, _, n, s in rows for i in range(k * 1000, k * 1000 + n)]
    assigned = spark.createDataFrame(events, "recording string, interval_id int, channel int, event_id bigint, x array<double>, cluster int")
    labelled = M.label_events(assigned, merged, M.unit_table(merged))
    counts = {(r.label, r.kept): r["count"] for r in labelled.groupBy("label", "kept").count().collect()}
    assert counts == {(0, True): 698, (1, False): 2, (2, True): 300}
    monkeypatch.setattr(plans, "BROADCAST_BYTES", 0)
    assert M.label_events(assigned, merged, M.unit_table(merged)).filter("kept").count() == 998
    report = run_report(summary, M.unit_table(merged))
    check_conservation(report)
    r = report.first()
    assert (r.events, r.clusters, r.units, r.kept_units, r.kept_events, r.thrown_events) == (1000, 4, 3, 2, 998, 2)
    with pytest.raises(ValueError):
        check_conservation(report.withColumn("thrown_events", F.lit(0)))


def two_class(spark, seed=0, per=40, width=3, classes=2):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (per, width)) + 2.0 * c for c in range(classes)])
    label = np.repeat(np.arange(classes) * 3, per)
    rows = [("r", 0, 0, i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "recording string, interval_id int, channel int, event_id bigint, x array<double>, label int").repartition(3), x, label


def loss_of(w, b, x, y):
    return 0.5 * w @ w + 100 * np.maximum(0, 1 - y * (x @ w + b)).sum()


def test_batch_descent_matches_brute_force(spark):
    df, x, label = two_class(spark, classes=3)
    got = {r.label: r for r in S.fit_svm(df, "BGD", width=3).collect()}
    assert all(r.done for r in got.values())
    for c in (0, 3, 6):
        y = np.where(label == c, 1, -1)
        w, b, old, steps = np.zeros(3), 0.0, loss_of(np.zeros(3), 0, x, y), 0
        while True:
            low = y * (x @ w + b) < 1
            w, b = w - 3e-7 * (w + 100 * -(y * low) @ x), b - 3e-7 * 100 * -(y * low).sum()
            steps += 1
            new = loss_of(w, b, x, y)
            if abs(old - new) / old * 100 < 0.25:
                break
            old = new
        assert got[c].steps == steps
        assert np.allclose(got[c].w, w, rtol=1e-9) and got[c].b == pytest.approx(b) and got[c].loss == pytest.approx(new)


@pytest.mark.parametrize("mode,batch,rate", [("MBGD", 20, 1e-5), ("SGD", 1, 1e-4)])
def test_mini_batches_match_brute_force(spark, mode, batch, rate):
    df, x, label = two_class(spark)
    placed = S.with_batches(df, S.SCOPE, batch, 1).toPandas().sort_values("event_id")
    sizes = placed.groupby("batch").size()
    assert set(sizes) == {batch} and len(sizes) == 80 // batch == placed.batches.iloc[0]
    got = {r.label: r for r in S.fit_svm(df, mode, width=3, fixed_steps=6).collect()}
    y = np.where(label == 3, 1, -1)
    w, b = np.zeros(3), 0.0
    for t in range(6):
        low = (y * (x @ w + b) < 1) & (placed.batch.to_numpy() == t % (80 // batch))
        w, b = w - rate * (w + 100 * -(y * low) @ x), b - rate * 100 * -(y * low).sum()
    assert np.allclose(got[3].w, w, rtol=1e-9) and got[3].b == pytest.approx(b)


def test_a_step_of_descent_is_one_job(spark, monkeypatch):
    """Points stay where they are and models on the driver; with too many models, steps give the same through tables."""
    df, _, _ = two_class(spark, classes=3)
    jobs, fitted = [], []
    for steps in (2, 7):
        spark.sparkContext.setJobGroup(f"descent-{steps}", "steps")
        fitted = S.fit_svm(df, "BGD", width=3, fixed_steps=steps).orderBy("label").collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"descent-{steps}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] == 5
    monkeypatch.setattr(S, "HELD_BYTES", -1)
    for a, b in zip(fitted, S.fit_svm(df, "BGD", width=3, fixed_steps=7).orderBy("label").collect()):
        assert np.allclose(a.w, b.w, rtol=1e-12) and (a.label, a.steps, a.done) == (b.label, b.steps, b.done)


def test_library_svm_fits_on_few_tasks(spark, monkeypatch):
    """Classes are fitted side by side, so each has its share of the cores and no tree of many partial sums."""
    df, _, _ = two_class(spark, classes=4)
    parts = []
    fit = S.OneVsRest.fit
    monkeypatch.setattr(S.OneVsRest, "fit", lambda self, data: parts.append(data.rdd.getNumPartitions()) or fit(self, data))
    assert S.library_svm(df).count() == 4
    assert parts == [1]


def test_descent_without_progress_ends(spark):
    """Steps far too long: the loss only grows, the stop rule is not met, and the models say so."""
    df, _, _ = two_class(spark)
    plan = S.MODES["MBGD"]
    S.MODES["MBGD"] = S.replace(plan, rate=0.5)
    try:
        got = S.fit_svm(df, "MBGD", width=3, patience=4).collect()
    finally:
        S.MODES["MBGD"] = plan
    assert len(got) == 2 and not any(r.done for r in got) and all(4 <= r.steps < 60 for r in got)


def test_svm_modes_and_prediction(spark):
    df, x, label = two_class(spark)
    with pytest.raises(ValueError):
        S.fit_svm(df, "ADAM")
    fitted = S.fit_svm(df, "MBGD", width=3, max_steps=30, eval_every=3)
    assert fitted.count() == 2
    library = S.library_svm(df).withColumn("recording", F.lit("r")).withColumn("interval_id", F.lit(0))
    got = S.predict(df, library, width=3).toPandas().sort_values("event_id")
    assert (got.predicted.to_numpy() == label).mean() > 0.9
    slow = S.fit_svm(df, "BGD", width=3, fixed_steps=5)
    optimum = {r.label: r.loss for r in S.svm_loss(df, library, 3).collect()}
    start = {r.label: r.loss for r in S.svm_loss(df, slow, 3).collect()}
    assert all(optimum[c] < start[c] for c in optimum)
    tie = spark.createDataFrame([("r", 0, c, [1.0, 0.0, 0.0], 0.5) for c in (7, 3, 5)], "recording string, interval_id int, label int, w array<double>, b double")
    assert {r.predicted for r in S.predict(df, tie, width=3).collect()} == {3}


def test_scatter(spark):
    df, x, _ = two_class(spark)
    got = scatter_2d(df).toPandas().sort_values("event_id")
    assert len(got) == 80 and got.px.var() > got.py.var()
    assert scatter_2d(df, {0: 1.0, 3: 0.0}).count() == 40
    assert clouds().shape == (180, 4)


def test_samples_without_a_model_stay(spark):
    df, _, _ = two_class(spark)
    models = S.fit_svm(df, "BGD", width=3, fixed_steps=2)
    other = df.withColumn("interval_id", F.lit(5))
    got = S.predict(df.unionByName(other), models, width=3)
    assert got.filter("interval_id = 5 and predicted is null and score is null").count() == 80
    assert got.filter("interval_id = 0 and predicted is not null").count() == 80


def test_greedy_merge_of_many_clusters_is_fast(spark):
    rng = np.random.default_rng(3)
    n = 20_000
    args = rng.normal(0, 3, (n, 4)), rng.integers(1, 50, n), np.repeat(np.arange(n // 5), 5), np.repeat(np.arange(n // 5), 5)
    begin = time.time()
    found = M._merge_in_order(args[0] * args[1][:, None], *args[1:], 8, 2.0, 8, False)
    assert time.time() - begin < 20 and (found <= np.arange(n)).all() and (found[found] == found).all()


def test_mutual_merge_ends_without_pairs(spark):
    rows = summary_rows(np.random.default_rng(6), range(60))
    table = summary_table(spark, rows)
    merged = M.merge_clusters(table, "mutual", similarity=1.0)
    units = merged.groupBy(*M.SCOPE, F.col("unit").alias("ord")).agg(
        F.sum("n").alias("n"), M.sum_by_position("sum", len(rows[0][4])).alias("sum"), F.min("s_chn").alias("s_chn"), F.max("e_chn").alias("e_chn")
    )
    assert M.vicinity_pairs(units).filter("distance < 1.0").count() == 0


def test_mutual_merge_of_many_clusters_is_fast():
    rng = np.random.default_rng(3)
    n = 20_000
    sums, counts, channels = rng.normal(0, 3, (n, 4)), rng.integers(1, 50, n), np.repeat(np.arange(n // 5), 5)
    begin = time.time()
    found = M._merge_mutual_rows(sums * counts[:, None], counts, channels, channels.copy(), 8, 2.0)
    assert time.time() - begin < 20 and (found <= np.arange(n)).all() and (found[found] == found).all()


def test_dropped_events_are_conserved(spark):
    found = spark.createDataFrame([("r", 0, 12, 2), ("r", 1, 3, 3)], "recording string, interval_id int, found_events bigint, dropped_events bigint")
    summary = spark.createDataFrame([("r", 0, 7, 10)], "recording string, interval_id int, ord bigint, n bigint")
    units = spark.createDataFrame([("r", 0, 10, True)], "recording string, interval_id int, n bigint, kept boolean")
    report = run_report(summary, units, found)
    check_conservation(report)
    assert {r.interval_id: (r.events, r.found_events, r.dropped_events) for r in report.collect()} == {0: (10, 12, 2), 1: (0, 3, 3)}
    with pytest.raises(ValueError):
        check_conservation(report.withColumn("dropped_events", F.lit(0)))
