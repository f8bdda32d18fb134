import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wavemark.config import HashConfig
from wavemark.operators.hashes import fingerprints, range_pairs

SCHEMA = "track_name string, time float, freq float"


def made(spark, peaks, cfg=HashConfig()):
    return fingerprints(spark.createDataFrame([("t", float(t), float(f)) for t, f in peaks], SCHEMA), cfg).collect()


def test_few_peaks(spark):
    assert made(spark, []) == [] and made(spark, [(0, 440)]) == []


def test_too_far_apart(spark):
    assert made(spark, [(0, 440), (2, 500)]) == []


def test_anchor_time(spark):
    (row,) = made(spark, [(0.1, 440), (0.5, 880)])
    assert math.isclose(row.anchor_time, 0.1, rel_tol=1e-6)


def test_fan_limit(spark):
    rows = made(spark, [(0.04 * i, 300 + i) for i in range(21)], HashConfig(fan_value=5))
    per = {}
    for r in rows:
        per[r.seq] = per.get(r.seq, 0) + 1
    assert max(per.values()) == 5
    assert made(spark, [(0, 1), (0.1, 2)], HashConfig(fan_value=0)) == []


def test_order_of_input_is_irrelevant(spark):
    peaks = [(0.0, 440), (0.3, 880), (0.6, 1320)]
    assert sorted(r.hash for r in made(spark, peaks)) == sorted(r.hash for r in made(spark, peaks[::-1]))


def test_different_constellations_rarely_collide(spark):
    a = {r.hash for r in made(spark, [(0, 100), (0.3, 200), (0.6, 300)])}
    b = {r.hash for r in made(spark, [(0, 500), (0.3, 900), (0.6, 1200)])}
    assert not a & b


def test_skipped_targets_do_not_use_the_fan(spark):
    rows = made(spark, [(0, 100), (0.05, 200), (0.2, 300), (0.3, 400)], HashConfig(fan_value=1, min_dt=0.1))
    assert [r.hash & 0xFFFFF for r in rows if r.seq == 0] == [20]


def test_same_time_pairs_count(spark):
    assert len(made(spark, [(0, 100), (0, 200)])) == 1


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(50, 11000)), max_size=25), st.integers(1, 4), st.sampled_from([0.0, 0.25]), st.sampled_from([0.5, 2.0, math.inf, 0.0]))
def test_band_join_is_a_loop(spark, peaks, fan, lo, hi):
    cfg = HashConfig(fan_value=fan, min_dt=lo, max_dt=hi)
    ordered = sorted({(t / 8, f) for t, f in peaks})
    expect = []
    for i, (t, _) in enumerate(ordered):
        targets = [u for u, _ in ordered[i + 1 :] if lo <= u - t <= hi][:fan]
        expect += [(i, u - t) for u in targets]
    rows = spark.createDataFrame([("t", t, float(f)) for t, f in ordered], SCHEMA)
    assert sorted((r.seq, r.dt) for r in range_pairs(rows, cfg).select("seq", "dt").collect()) == sorted(expect)


def test_config_defaults():
    from wavemark.config import PRESETS, PipelineConfig

    d = PipelineConfig()
    assert (d.hashes.fan_value, d.hashes.freq_bins, d.peaks.threshold_db, d.index.offset_bin_size) == (15, 1024, -40.0, 0.05)
    assert PRESETS["speech"].hashes.max_dt == 2.0
    assert PipelineConfig.derive(44100, 4096).hashes.freq_resolution == pytest.approx(44100 / 4096)


@pytest.mark.parametrize("hashes", [{}, {"max_dt": 0.3, "fan_value": 3}, {"min_dt": 0.1}, {"fan_value": 0}, {"freq_bins": 4}], ids=str)
def test_one_pass_is_the_plan(spark, hashes):
    import numpy as np

    from wavemark.config import PipelineConfig
    from wavemark.operators.hashes import fingerprints_from_signals
    from wavemark.operators.peaks import peaks_from_signals

    cfg = PipelineConfig.derive(64, 16, 4, {"time_neighborhood": 2, "freq_neighborhood": 2, "threshold_db": -20.0}, hashes)
    rows = [(f"t{i}", np.random.default_rng(i).normal(size=n).tolist()) for i, n in enumerate((400, 90, 5, 16))]
    rows = spark.createDataFrame([*rows, ("none", None)], "track_name string, samples array<float>")
    a, b = fingerprints_from_signals(rows, cfg), fingerprints(peaks_from_signals(rows, cfg), cfg.hashes)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert hashes.get("fan_value") == 0 or a.count() > 20


def test_fingerprints_of_short_tracks_leave_together():
    import numpy as np
    import pyarrow as pa

    from wavemark.config import PipelineConfig
    from wavemark.operators.hashes import fingerprints_from_signals

    class Caught:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    cfg = PipelineConfig.derive(64, 16, 4, {"time_neighborhood": 2, "freq_neighborhood": 2}, {"max_dt": 0.5})
    samples = [np.random.default_rng(i).random(66).astype(np.float32) for i in range(300)]
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([f"t{i}" for i in some]), pa.array([samples[i] for i in some], pa.list_(pa.float32()))], ["track_name", "samples"])
    run = fingerprints_from_signals(Caught(), cfg)
    together = list(run(iter([batch(range(300))])))
    alone = [b for i in range(300) for b in run(iter([batch([i])]))]
    assert len(together) == 1 and together[0].num_rows > 300
    assert pa.Table.from_batches(together).equals(pa.Table.from_batches(alone).combine_chunks())
