"""Signals to levels by time and frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as W
from .. import schemas
from ..config import SpectrogramConfig
from .dsp import FRAMES, frame_total, spectrum_db


def frames(signals: DataFrame, cfg: SpectrogramConfig) -> DataFrame:
    """(track_name, frame, samples): overlapping frames; a signal shorter than a window has none."""
    cfg.check()
    n = W.frame_count(F.col("samples"), cfg.window_size, cfg.hop_size)
    rows = signals.withColumn("n", n).filter("n > 0").select("track_name", "samples", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame"))
    return rows.select("track_name", "frame", W.framed(F.col("samples"), F.col("frame"), cfg.window_size, cfg.hop_size).alias("samples"))


def windowed_frames(signals: DataFrame, cfg: SpectrogramConfig) -> DataFrame:
    return frames(signals, cfg).withColumn("samples", W.windowed(F.col("samples"), cfg.window_size))


def cells(signals: DataFrame, cfg: SpectrogramConfig) -> DataFrame:
    """(track_name, frame, bin, db) in SQL operations alone: sums over a frame for each bin, in the
    order of its samples. For small windows; the work grows with the window's square."""
    size = cfg.window_size
    rows = windowed_frames(signals, cfg).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(size // 2))))

    def part(wave) -> F.Column:
        terms = F.transform("samples", lambda v, j: v.cast("double") * wave(2 * F.pi() * F.col("bin") * j / size))
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)

    rows = rows.select("track_name", "frame", "bin", part(F.cos).alias("re"), part(F.sin).alias("im"))
    return rows.select("track_name", "frame", "bin", W.decibels(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("db"))


def spectrogram(signals: DataFrame, cfg: SpectrogramConfig) -> DataFrame:
    """(track_name, frame, db array) by fast Fourier transform, in Arrow batches of frames."""
    cfg.check()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(W.hann_weights(cfg.window_size), np.float32)
        for batch in batches:
            for name, samples in zip(batch.column(0), batch.column(1), strict=True):
                samples = samples.values.to_numpy(zero_copy_only=False) if samples.is_valid else np.zeros(0, np.float32)
                total = frame_total(len(samples), cfg.window_size, cfg.hop_size)
                for first in range(0, total, FRAMES):
                    last = min(total, first + FRAMES)
                    db = spectrum_db(samples, cfg.window_size, cfg.hop_size, first, last, weights)
                    offsets = np.arange(len(db) + 1, dtype=np.int32) * db.shape[1]
                    levels = pa.ListArray.from_arrays(pa.array(offsets), pa.array(db.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(db), pa.string()), pa.array(np.arange(first, last, dtype=np.int32)), levels], ["track_name", "frame", "db"])

    return signals.select("track_name", "samples").mapInArrow(run, schemas.SPECTROGRAM)


def to_cells(spectrogram: DataFrame) -> DataFrame:
    return spectrogram.select("track_name", "frame", F.posexplode("db").alias("bin", "db"))
