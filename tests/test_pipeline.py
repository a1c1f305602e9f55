import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.merge import SCOPE
from pulsegrid.plans.pipeline import event_times, sort_recording
from pulsegrid.sources.sinks import commit_result, committed, pending, read_result

CHANNELS, SECONDS = 16, 2


def planted(path):
    """Five units, each seen on one to three neighbouring channels, one shape per unit."""
    rng = np.random.default_rng(11)
    samples = 30000 * SECONDS
    data = rng.normal(0, 4, (CHANNELS, samples))
    axis = np.arange(-20, 40)
    truth = []
    for unit, home in enumerate((0, 1, 6, 11, 12)):
        narrow, wide = (3.0, 10), (5.0, 16)
        w, shift = narrow if unit % 2 else wide
        shape = np.exp(-0.5 * (axis / w) ** 2) - 0.6 * np.exp(-0.5 * ((axis - shift) / (1.7 * w)) ** 2)
        times = np.sort(rng.choice(np.arange(200, samples - 300, 400), 90, replace=False)) + 60 * unit
        for at in times:
            for step, gain in ((0, 1.0), (1, 0.6)):
                if home + step < CHANNELS - 2:
                    data[home + step, at - 20 : at + 40] += 450 * gain * shape
            truth.append((unit, home, at))
    np.rint(data).clip(-32000, 32000).astype("<i2").T.tofile(path)
    return truth


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    path = tmp_path_factory.mktemp("probe") / "probe.bin"
    return str(path), planted(path)


def test_planted_units_are_found(spark, recording, tmp_path):
    path, truth = recording
    done = sort_recording(
        spark, path, channels=CHANNELS, interval_s=SECONDS, basis="pooled", cluster="km", max_steps=3, output=str(tmp_path / "out")
    )
    report = done.report.first()
    assert report.kept_events + report.thrown_events == report.events == done.assigned.count()
    assert report.units <= report.clusters and report.kept_units == done.weights.count()
    found = done.assigned.select("channel", "event_id").toPandas()
    hit = 0
    for _, home, at in truth:
        peaks = found[found.channel == home].event_id.to_numpy()
        hit += bool(len(peaks)) and np.abs(peaks - at).min() <= 20
    assert hit / len(truth) > 0.85
    stored = read_result(spark, str(tmp_path / "out" / "labelled"))
    assert stored.count() == report.kept_events and stored.schema["recording"].dataType.simpleString() == "string"
    with pytest.raises(ValueError, match="already committed"):
        done.write(str(tmp_path / "out"))
    done.write(str(tmp_path / "out"), "overwrite")
    stored = read_result(spark, str(tmp_path / "out" / "labelled"))
    assert stored.count() == report.kept_events
    scored = done.predict(stored.select("recording", "interval_id", "channel", "event_id", "x"))
    assert scored.filter("predicted is null").count() == 0
    seconds = event_times(done.labelled).agg(F.max("seconds")).first()[0]
    assert 1 < seconds < SECONDS


def test_result_does_not_depend_on_block_length_or_intervals_mixing(spark, recording):
    path, _ = recording
    settings = dict(channels=CHANNELS, interval_s=1, max_steps=1, minimal_support=0.02)
    columns = ["interval_id", "channel", "event_id", "cluster", "unit", "label"]
    whole = sort_recording(spark, path, **settings).labelled.select(columns).toPandas()
    cut = sort_recording(spark, path, block_len=4096, **settings).labelled.select(columns).toPandas()
    first = sort_recording(spark, path, first_interval_only=True, **settings).labelled.select(columns).toPandas()
    order = lambda d: d.sort_values(columns).reset_index(drop=True)
    assert len(whole) > 200 and order(whole).equals(order(cut))
    assert order(whole[whole.interval_id == 0]).equals(order(first))


@pytest.mark.parametrize("options", [dict(features="mlpca", cluster="mlkm"), dict(cluster="gmm", merge="mutual", svm="MBGD"), dict(svm="library")])
def test_other_methods_run_end_to_end(spark, recording, options):
    path, _ = recording
    done = sort_recording(spark, path, channels=CHANNELS, interval_s=SECONDS, max_steps=1, **options)
    assert done.labelled.count() > 100
    assert done.unit_map.select(*SCOPE, "unit").distinct().count() == done.units.count()


def test_no_events_gives_empty_results(spark, tmp_path):
    np.zeros((4, 3000), dtype="<i2").T.tofile(tmp_path / "flat.bin")
    done = sort_recording(spark, str(tmp_path / "flat.bin"), channels=4, interval_s=1)
    assert [t.count() for t in (done.assigned, done.summary, done.units, done.labelled, done.weights, done.report)] == [0] * 6


ROWS = "recording string, interval_id int, event_id bigint, x array<double>"


def test_a_run_replaces_its_own_intervals(spark, tmp_path):
    path = str(tmp_path / "kept")
    table = lambda rows: spark.createDataFrame([(r, i, e, [float(v)]) for r, i, e, v in rows], ROWS)
    seen = lambda: sorted((r.recording, r.interval_id, r.event_id, r.x[0]) for r in read_result(spark, path).collect())
    wanted = table([("007", 0, 0, 0), ("007", 1, 0, 0), ("a/b c", 0, 0, 0)])
    assert pending(wanted, path).count() == 3
    with pytest.raises(ValueError, match="nothing is committed"):
        read_result(spark, path)
    commit_result(table([("007", 0, 1, 1), ("007", 1, 1, 2), ("a/b c", 0, 1, 3), ("a/b c", 0, 2, 4)]), path)
    assert seen() == [("007", 0, 1, 1.0), ("007", 1, 1, 2.0), ("a/b c", 0, 1, 3.0), ("a/b c", 0, 2, 4.0)]
    commit_result(table([("007", 1, 5, 9)]), path)
    assert seen() == [("007", 0, 1, 1.0), ("007", 1, 5, 9.0), ("a/b c", 0, 1, 3.0), ("a/b c", 0, 2, 4.0)]
    # A repeated run without events in an interval leaves it empty.
    commit_result(table([("007", 0, 1, 7)]), path, done=table([("007", 0, 0, 0), ("007", 1, 0, 0)]))
    assert seen() == [("007", 0, 1, 7.0), ("a/b c", 0, 1, 3.0), ("a/b c", 0, 2, 4.0)]
    assert pending(wanted, path).count() == 0 and committed(spark, path).count() == 3
    # Rows that a run wrote before it was cut off are not seen, and their interval is still to do.
    table([("new", 0, 1, 1)]).write.mode("append").partitionBy("recording", "interval_id").parquet(f"{path}/data")
    assert len(seen()) == 3 and pending(table([("new", 0, 0, 0)]), path).count() == 1
