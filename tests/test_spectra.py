import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemark.config import PeakConfig, PipelineConfig, SpectrogramConfig
from wavemark.errors import SpectrogramError
from wavemark.operators.dsp import sliding_max, strict_maxima, track_peaks
from wavemark.operators.peaks import peaks_from_cells, peaks_from_signals, sequenced
from wavemark.operators.spectrogram import cells, spectrogram, to_cells

SMALL = SpectrogramConfig(256, 128)


def signal(spark, *tracks):
    return spark.createDataFrame([(f"t{i}", [float(x) for x in s]) for i, s in enumerate(tracks)], "track_name string, samples array<float>")


def grid(spark, db):
    return spark.createDataFrame([("t", f, b, float(db[f, b])) for f in range(db.shape[0]) for b in range(db.shape[1])], "track_name string, frame int, bin int, db float")


def brute(db, t, f, threshold):
    out = set()
    for i in range(db.shape[0]):
        for j in range(db.shape[1]):
            v = db[i, j]
            if v < threshold:
                continue
            near = [(a, b) for a in range(max(0, i - t), min(db.shape[0], i + t + 1)) for b in range(max(0, j - f), min(db.shape[1], j + f + 1)) if (a, b) != (i, j)]
            if not any(db[x] >= v for x in near):
                out.add((i, j))
    return out


def test_shape_and_silence(spark):
    rows = spectrogram(signal(spark, [0.0] * 1024), SMALL).collect()
    assert len(rows) == 7 and all(len(r.db) == 129 and max(r.db) < -80 for r in rows)


def test_short_and_zero(spark):
    assert spectrogram(signal(spark, [0.0] * 100), SMALL).count() == 0
    with pytest.raises(SpectrogramError):
        SpectrogramConfig(0, 1).check()
    with pytest.raises(SpectrogramError):
        SpectrogramConfig().check_length(100)


def test_sine_is_loudest_at_its_bin(spark):
    tone = np.sin(2 * np.pi * 440 * np.arange(4096) / 22050)
    row = spectrogram(signal(spark, tone), SpectrogramConfig(2048, 2048)).orderBy("frame").first()
    assert abs(int(np.argmax(row.db)) - 41) <= 2


def test_native_cells_are_the_transform(spark):
    x = np.random.default_rng(1).normal(size=100)
    cfg = SpectrogramConfig(16, 4)
    a = {(r.frame, r.bin): r.db for r in cells(signal(spark, x), cfg).collect()}
    b = {(r.frame, r.bin): r.db for r in to_cells(spectrogram(signal(spark, x), cfg)).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-3


CASES = [
    ((50, 129), {(25, 64): -10}, 1),
    ((100, 129), {(10, 20): -5, (60, 100): -15}, 2),
    ((50, 129), {(25, 64): -50}, 0),
    ((50, 129), {(25, 64): -10, (26, 65): -20}, 1),
    ((50, 129), {(25, 64): -10, (26, 65): -10}, 0),
    ((20, 20), {(5, 5): -40}, 1),
]


@pytest.mark.parametrize(("shape", "points", "n"), CASES)
def test_injected_peaks(spark, shape, points, n):
    db = np.full(shape, -100, np.float32)
    for at, v in points.items():
        db[at] = v
    cfg = PeakConfig(5, 5, -40.0)
    found = peaks_from_cells(grid(spark, db), cfg).collect()
    assert len(found) == n == int(strict_maxima(db, 5, 5, -40).sum())
    if n == 1:
        assert found[0].amplitude == max(points.values())


def test_peaks_are_sequenced_by_time(spark):
    db = np.full((100, 129), -100, np.float32)
    db[80, 10] = db[20, 90] = -5
    rows = sequenced(peaks_from_cells(grid(spark, db), PeakConfig(5, 5))).orderBy("seq").collect()
    assert [r.frame for r in rows] == [20, 80]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 3), st.integers(0, 3), st.integers(1, 14), st.integers(1, 14))
def test_strict_maxima_is_brute_force(seed, t, f, n, m):
    db = np.random.default_rng(seed).integers(-8, 0, (n, m)).astype(np.float32)
    assert set(zip(*(x.tolist() for x in np.nonzero(strict_maxima(db, t, f, -6))), strict=True)) == brute(db, t, f, -6)


@pytest.mark.parametrize(("t", "f"), [(0, 0), (0, 2), (2, 0), (1, 1), (3, 2)])
def test_window_form_is_brute_force(spark, t, f):
    db = np.random.default_rng(t * 7 + f).integers(-9, 0, (12, 11)).astype(np.float32)
    got = {(r.frame, r.bin) for r in peaks_from_cells(grid(spark, db), PeakConfig(t, f, -6.0)).collect()}
    assert got == brute(db, t, f, -6)


def test_nan_cell_is_a_peak_and_suppresses_none(spark):
    db = np.full((5, 5), -100, np.float32)
    db[2, 2], db[2, 3] = np.nan, -10
    assert {(r.frame, r.bin) for r in peaks_from_cells(grid(spark, db), PeakConfig(1, 1)).collect()} == {(2, 2), (2, 3)}
    assert set(zip(*(x.tolist() for x in np.nonzero(strict_maxima(db, 1, 1, -40))), strict=True)) == {(2, 2), (2, 3)}


def test_empty_grid(spark):
    assert peaks_from_cells(spark.createDataFrame([], "track_name string, frame int, bin int, db float"), PeakConfig()).count() == 0


def test_sliding_max_bounds():
    x = np.arange(10.0)[None]
    assert sliding_max(x, -2, -1, 1)[0].tolist() == [-np.inf, 0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert sliding_max(x, 1, 3, 1)[0].tolist() == [3, 4, 5, 6, 7, 8, 9, 9, 9, -np.inf]


def test_runs_of_frames_join_without_a_seam(monkeypatch):
    from wavemark.operators import dsp

    cfg = PipelineConfig.derive(64, 16, 4, {"time_neighborhood": 3, "freq_neighborhood": 2, "threshold_db": -30.0})
    x = np.random.default_rng(2).normal(size=2000).astype(np.float32)
    whole = [np.concatenate(v) for v in zip(*track_peaks(x, cfg), strict=True)]
    monkeypatch.setattr(dsp, "FRAMES", 37)
    parts = [np.concatenate(v) for v in zip(*track_peaks(x, cfg), strict=True)]
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True)) and len(whole[0]) > 20


def test_vectorised_and_window_forms_agree(spark):
    cfg = PipelineConfig.derive(64, 16, 4, {"time_neighborhood": 2, "freq_neighborhood": 2, "threshold_db": -20.0})
    rows = signal(spark, *[np.random.default_rng(i).normal(size=120) for i in range(4)])
    a = {tuple(r) for r in peaks_from_cells(cells(rows, cfg.spectrogram), cfg.peaks).select("track_name", "frame", "bin", "time", "freq").collect()}
    b = {tuple(r) for r in peaks_from_signals(rows, cfg).select("track_name", "frame", "bin", "time", "freq").collect()}
    assert a == b and len(a) > 10
    assert peaks_from_signals(rows.withColumn("samples", F.lit(None).cast("array<float>")), cfg).count() == 0


def test_texts_are_read_in_the_task_and_peaks_leave_together(spark, monkeypatch):
    """Samples of a text are those of the view in SQL operations, and so are its peaks; short tracks'
    peaks share batches, and the window's weights are made once a task."""
    from pyspark.sql import functions as F

    from wavemark.operators import peaks
    from wavemark.plans import catalogue

    rng = np.random.default_rng(8)
    texts = ["", "a", "é€\U0001f600\x00 z", None, *("".join(map(chr, rng.integers(32, 400, n))) for n in (255, 256, 257, 700, 3_000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    chars = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: catalogue.W.pcm_sample(F.ascii(c) - 128, 8))
    signals = rows.select(F.col("doc_id").cast("string").alias("track_name"), chars.alias("samples"))
    for got, text in zip(signals.orderBy("track_name").collect(), texts, strict=True):
        assert got.samples is None if text is None else np.float32(got.samples).tolist() == catalogue.characters(pa.scalar(text)).tolist()
    packed = rows.select(F.col("doc_id").cast("string").alias("track_name"), F.col("text").alias("samples"))
    one, two = peaks.peaks_from_signals(signals, catalogue.DOC), peaks.peaks_from_signals(packed, catalogue.DOC, catalogue.characters)
    assert one.count() > 50 and sorted(one.collect()) == sorted(two.collect())
    held = []
    monkeypatch.setattr(peaks, "track_peaks", lambda samples, cfg, weights: held.append(weights) or track_peaks(samples, cfg, weights))

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            self.run = f

    frame = Frame()
    peaks.peaks_from_signals(frame, catalogue.DOC, catalogue.characters)
    batches = list(frame.run(iter([pa.record_batch([pa.array(map(str, range(9))), pa.array(texts)], ["track_name", "samples"])])))
    assert len(batches) == 1 and batches[0].num_rows == one.count() and len(set(map(id, held))) == 1
