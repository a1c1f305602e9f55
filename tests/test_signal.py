import numpy as np
import pytest
from pyspark.sql import functions as F
from rules import events_of, pulses, sequential_filter

from pulsegrid.functions.butterworth import bandpass_coefficients
from pulsegrid.operators import detect
from pulsegrid.operators.bandpass import bandpass, bandpass_joined, entry_states, warm_up
from pulsegrid.plans import spread as plans
from pulsegrid.plans.select import exact_median
from pulsegrid.plans.spread import number_rows
from pulsegrid.sources import series as sources
from pulsegrid.sources.series import centre, explode_blocks, series_from_table, signal_blocks

SERIES = "recording string, interval_id int, channel int, sample bigint, value double"


def series(spark, data):
    rows = [("r", 0, c, i, float(v)) for c, line in enumerate(data) for i, v in enumerate(line)]
    return spark.createDataFrame(rows, SERIES)


def test_filter_coefficients():
    b, a = bandpass_coefficients(300, 6000, 30000)
    assert np.allclose(b, [0.19061660009749765, 0, -0.3812332001949953, 0, 0.19061660009749765])
    assert np.allclose(a, [1, -2.3350824020765124, 1.9509646897792021, -0.8192636853124013, 0.20667198516656435])
    with pytest.raises(ValueError):
        bandpass_coefficients(6000, 300, 30000)


@pytest.mark.parametrize("frequency,gain", [(30, 0.009), (300, 0.707), (1342, 1.0), (6000, 0.707), (12000, 0.051)])
def test_filter_gain(frequency, gain):
    b, a = bandpass_coefficients(300, 6000, 30000)
    z = np.exp(-2j * np.pi * frequency / 30000)
    assert abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) == pytest.approx(gain, abs=1e-3)


@pytest.mark.parametrize("block_len", [700, 6000])
def test_blocked_filter_is_the_sequential_one(spark, block_len):
    data = np.rint(pulses(channels=2))
    b, a = bandpass_coefficients(300, 6000, 30000)
    blocks = signal_blocks(series(spark, data), block_len, lead=warm_up() + 30, tail=202)
    filtered = bandpass(blocks, keep_lead=30)
    got = explode_blocks(filtered, "y").toPandas().sort_values(["channel", "sample"])
    for c in range(2):
        assert np.abs(got[got.channel == c].value.to_numpy() - sequential_filter(b, a, data[c])).max() < 1e-9


@pytest.mark.parametrize("block_len,lead,fan", [(64, 0, 1024), (64, 20, 5), (100, 250, 3), (6000, 0, 1024)])
def test_joined_filter_is_the_sequential_one(spark, block_len, lead, fan):
    """Also for a band so narrow that states last longer than the interval."""
    data = np.rint(pulses(channels=2))
    for low, high in ((300, 6000), (300, 330)):
        b, a = bandpass_coefficients(low, high, 30000)
        blocks = signal_blocks(series(spark, data), block_len, lead=lead, tail=30)
        filtered = bandpass_joined(blocks, low, high, lead=lead, fan=fan)
        got = explode_blocks(filtered, "y").toPandas().sort_values(["channel", "sample"])
        total = {r.channel: r.s for r in filtered.groupBy("channel").agg(F.sum("abs_sum").alias("s")).collect()}
        for c in range(2):
            expect = sequential_filter(b, a, data[c])
            assert np.abs(got[got.channel == c].value.to_numpy() - expect).max() < 1e-5 * np.abs(expect).max()
            assert total[c] == pytest.approx(np.abs(expect).sum())
    if block_len < 6000:  # a block at the begin of an interval carries no earlier samples
        with pytest.raises(Exception, match="lead says"):
            bandpass_joined(blocks, lead=lead + 1).count()


def test_states_of_many_runs_are_joined_in_batches(spark):
    """Runs go through Arrow batches together, also where a batch ends inside a run; no group is a call of its own."""
    rng = np.random.default_rng(2)
    rows = [("r", 0, c, i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for c in (0, 1, 2) for i in range((7, 1, 23)[c])]
    maps = spark.createDataFrame(rows, "recording string, interval_id int, channel int, block bigint, m array<double>, z array<double>")
    expect = {}
    for c in (0, 1, 2):
        state = np.zeros(2, complex)
        for _, _, k, i, m, z in rows:
            if k == c:
                expect[c, i] = state
                state = state * np.array(m).view(complex) + np.array(z).view(complex)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        for fan in (3, 1024):
            states = entry_states(maps, fan)
            assert "FlatMapGroupsInPandas" not in states._jdf.queryExecution().toString()
            got = {(r.channel, r.block): np.array(r.state).view(complex) for r in states.collect()}
            assert got.keys() == expect.keys() and all(np.allclose(got[k], expect[k], rtol=1e-12) for k in expect)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_filter_refuses_short_lead(spark):
    blocks = signal_blocks(series(spark, pulses(channels=1)), 1000, lead=10)
    with pytest.raises(Exception, match="earlier samples"):
        bandpass(blocks).count()


@pytest.mark.parametrize("block_len,whole", [(250, False), (1024, False), (6000, True)])
@pytest.mark.parametrize("small", [True, False])
def test_detection_matches_brute_force(spark, block_len, whole, small, monkeypatch):
    if not small:
        if whole:
            pytest.skip("no join in this form")
        monkeypatch.setattr(plans, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(detect, "STRIDE", 500)
    data = np.rint(pulses())
    # edges: flat channel, two late pulses, ties, a pulse in the first samples, a channel with one event
    data[3] = 0
    edge = np.zeros_like(data[0])
    edge[[40, 51, 5850, 5930, 5944]] = [500, 500, 400, 400, 400]
    edge[3000:3004] = 300
    one = np.zeros_like(data[0])
    one[[1000, 3000]] = 500
    data = np.vstack([data, edge, one])
    blocks = signal_blocks(
        series(spark, data), block_len, lead=detect.lead_needed(50, 20), tail=detect.tail_needed(50, 20), values="y"
    )
    got = detect.detect_events(blocks, whole=whole).toPandas().sort_values(["channel", "peak"])
    expect = {c: events_of(line, 50, 8, 20, 1000) for c, line in enumerate(data)}
    assert sum(map(len, expect.values())) == len(got) > 20
    for c, pairs in expect.items():
        mine = got[got.channel == c]
        assert mine.peak.tolist() == [p for p, _ in pairs]
        for wave, (_, snippet) in zip(mine.wave, pairs):
            assert np.array_equal(wave, snippet)
    assert len(expect[5]) == 1
    two = detect.detect_events(blocks, whole=whole, min_events=2).toPandas()
    assert sorted(two.channel.unique()) == sorted(c for c, e in expect.items() if len(e) >= 2)


def test_keep_last(spark):
    one = np.zeros((1, 3000))
    one[0, [1000, 2000]] = 500
    blocks = signal_blocks(series(spark, one), 512, 30, 202, "y")
    assert detect.detect_events(blocks).count() == 1
    assert detect.detect_events(blocks, keep_last=True).count() == 2


def test_normalised_waves(spark):
    rows = [("r", 0, 0, 1, [1.0, 3.0, 5.0]), ("r", 0, 0, 2, [-2.0, 0.0, 2.0]), ("r", 0, 0, 3, [-1.0, 4.0])]
    waves = spark.createDataFrame(rows, "recording string, interval_id int, channel int, event_id bigint, wave array<double>")
    got = {r.event_id: r.wave for r in detect.normalise_waves(waves).collect()}
    assert got == {1: [2 / 6, 4 / 6, 1.0], 3: [-2 / 3, 1.0]}
    assert [r.event_id for r in detect.flat_waves(waves).collect()] == [2]


def test_row_numbers_agree_for_hot_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(v), int(i)) for i, (k, v) in enumerate(zip(rng.choice([0, 0, 0, 1, 2], 4000), rng.integers(0, 50, 4000)))]
    df = spark.createDataFrame(rows, "k int, v int, i int")
    plain = number_rows(df, ["k"], ["v", "i"]).orderBy("k", "sample").collect()
    ranged = number_rows(df, ["k"], ["v", "i"], window_limit=100).orderBy("k", "sample").collect()
    assert plain == ranged and len(plain) == 4000


@pytest.mark.parametrize("limit", [2_000_000, 20])
def test_exact_median(spark, limit):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in [(0, 501), (1, 40), (2, 1), (3, 2)] for v in rng.normal(size=n)]
    got = {r.k: r.m for r in exact_median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", "m", limit).collect()}
    for k in range(4):
        assert got[k] == pytest.approx(np.median([v for q, v in rows if q == k]), abs=1e-15)


def test_means_need_no_numbered_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(c, i, (7 * i) % 5 + (c or 0)) for c in (1, 2, None) for i in range(50)], "c int, i int, v bigint")
    make = lambda: series_from_table(rows, F.col("c"), ["i"], F.col("v"))
    expect = sorted(map(tuple, centre(make()).collect()))
    written = []
    monkeypatch.setattr(sources, "materialize", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or plans.materialize(df))
    assert sorted(map(tuple, centre(make(), write=False).collect())) == expect and len(expect) == 100
    assert len(written) == 1 and "row_number" not in written[0]
