import numpy as np
import pytest
from rules import events_of, pulses, sequential_filter

from pulsegrid.functions.butterworth import bandpass_coefficients
from pulsegrid.operators import detect
from pulsegrid.operators.bandpass import bandpass, warm_up
from pulsegrid.sources.recording import read_recording
from pulsegrid.sources.series import explode_blocks
from pulsegrid.sources.sinks import write_recording, write_result


def write_probe(path, data):
    np.rint(data).astype("<i2").T.tofile(path)


def test_scan_splits_into_channels_intervals_and_blocks(spark, tmp_path):
    data = np.random.default_rng(0).integers(-900, 900, (5, 2500)).astype("<i2")
    write_probe(tmp_path / "probe.bin", data)
    blocks = read_recording(
        spark, str(tmp_path), channels=5, sample_hz=1000, interval_s=1, block_len=300, lead=40, tail=30, partition_bytes=5000, min_tasks=1
    )
    assert blocks.rdd.getNumPartitions() == 3 + 3 + 1
    got = explode_blocks(blocks).toPandas().sort_values(["interval_id", "channel", "sample"])
    assert got.groupby("interval_id").size().tolist() == [5000, 5000, 2500]
    for c in range(5):
        assert np.array_equal(got[got.channel == c].value, data[c])
    edge = {(r.interval_id, r.block): r for r in blocks.filter("channel = 3").collect()}
    assert edge[1, 0].samples == data[3, 1000:1330].tolist()
    assert edge[1, 2].first == 560 and edge[1, 2].samples == data[3, 1560:1930].tolist()
    assert edge[2, 1].samples == data[3, 2260:2500].tolist()


def test_filters_reach_the_source(spark, tmp_path):
    write_probe(tmp_path / "probe.bin", np.arange(4 * 3000).reshape(4, 3000) % 999)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        blocks = read_recording(spark, str(tmp_path / "probe.bin"), channels=4, sample_hz=1000, interval_s=1)
        one = blocks.filter("interval_id = 1 and channel in (0, 2) and n_core > 0")
        assert one.rdd.getNumPartitions() == 1
        assert sorted((r.interval_id, r.channel) for r in one.collect()) == [(1, 0), (1, 2)]
        assert blocks.filter("interval_id > 5").count() == 0
        assert blocks.filter("interval_id >= 1 and interval_id < 2").count() == 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    limited = read_recording(spark, str(tmp_path / "probe.bin"), channels=4, sample_hz=1000, interval_s=1, max_frames=1000)
    assert limited.count() == 4


def test_packing_and_channel_groups(spark, tmp_path):
    data = np.random.default_rng(0).integers(-900, 900, (6, 1000)).astype("<i2")
    for i in range(9):
        write_probe(tmp_path / f"probe{i}.bin", data + i)
    settings = dict(channels=6, sample_hz=1000, interval_s=1)
    packed = read_recording(spark, str(tmp_path), min_tasks=3, **settings)
    assert packed.rdd.getNumPartitions() == 3 and packed.count() == 54
    split = read_recording(spark, str(tmp_path / "probe0.bin"), channel_groups=4, min_tasks=4, **settings)
    assert split.rdd.getNumPartitions() == 4
    assert {r.channel: r.samples for r in split.collect()} == {c: data[c].tolist() for c in range(6)}


def test_bad_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_recording(spark, str(tmp_path / "none.bin"))
    (tmp_path / "odd.bin").write_bytes(b"123456")
    with pytest.raises(Exception, match="whole number"):
        read_recording(spark, str(tmp_path / "odd.bin"), channels=2).count()


@pytest.mark.parametrize("block_len", [6000, 900])
def test_scan_filter_detect(spark, tmp_path, block_len):
    data = np.rint(pulses(channels=3, samples=12000, per_channel=30))
    write_probe(tmp_path / "probe.bin", data)
    lead, tail = detect.lead_needed(), detect.tail_needed()
    blocks = read_recording(
        spark, str(tmp_path / "probe.bin"), channels=3, sample_hz=6000, interval_s=1, block_len=block_len, lead=warm_up() + lead, tail=tail
    )
    events = detect.detect_events(bandpass(blocks, keep_lead=lead), whole=block_len == 6000)
    got = {(r.interval_id, r.channel, r.peak): r.wave for r in events.collect()}
    b, a = bandpass_coefficients(300, 6000, 30000)
    expect = {}
    for i in range(2):
        for c in range(3):
            y = sequential_filter(b, a, data[c, i * 6000 : (i + 1) * 6000])
            expect.update({(i, c, p): w for p, w in events_of(y, 50, 8, 20, 1000)})
    assert got.keys() == expect.keys() and len(got) > 10
    assert all(np.allclose(got[k], expect[k], atol=1e-8) for k in got)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 2, [3.0])], "interval_id int, label int, x array<double>")
    write_result(df, str(tmp_path / "p"), partition_by=("interval_id",))
    assert sorted(spark.read.parquet(str(tmp_path / "p")).select("label").collect()) == [(1,), (2,)]
    write_result(df, str(tmp_path / "c"), "csv")
    assert {r.x for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"[1.0,2.0]", "[3.0]"}
    with pytest.raises(ValueError):
        write_result(df, str(tmp_path / "x"), "xls")


def test_options_choose_intervals_and_channels(spark, tmp_path):
    data = np.random.default_rng(2).integers(-900, 900, (4, 3500)).astype("<i2")
    write_probe(tmp_path / "probe.bin", data)
    options = dict(channels=4, sample_hz=1000, interval_s=1, only_channels="2,0", min_tasks=1)
    some = explode_blocks(read_recording(spark, str(tmp_path), intervals="1-2", **options)).toPandas()
    assert set(zip(some.interval_id, some.channel)) == {(i, c) for i in (1, 2) for c in (0, 2)} and len(some) == 4000
    assert some[(some.interval_id == 2) & (some.channel == 2)].sort_values("sample").value.tolist() == data[2, 2000:3000].tolist()
    rest = read_recording(spark, str(tmp_path), intervals="3-", **options)
    assert {r.interval_id for r in rest.collect()} == {3}


def test_recordings_are_written_and_read_again(spark, tmp_path):
    rows = [(k, i, float(i * k), float(-i)) for k in (3, 8) for i in range(50)]
    frames = spark.createDataFrame(rows, "k int, i int, a double, b double").repartition(5)
    written = write_recording(frames, str(tmp_path / "out"), "k", ["i"], ["a", "b"]).collect()
    assert sorted((r.k, r.frames) for r in written) == [(3, 50), (8, 50)]
    got = np.fromfile(tmp_path / "out" / "8.bin", dtype="<i2").reshape(-1, 2)
    assert got[:, 0].tolist() == [8 * i for i in range(50)] and got[:, 1].tolist() == [-i for i in range(50)]
    with pytest.raises(Exception, match="16 bits"):
        write_recording(frames.withColumn("a", frames.a * 1000), str(tmp_path / "bad"), "k", ["i"], ["a"]).collect()
