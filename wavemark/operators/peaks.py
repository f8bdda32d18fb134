"""Levels to a constellation of strict local maxima."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as W
from .. import schemas
from ..config import PeakConfig, PipelineConfig
from .dsp import track_peaks

#: Peaks that leave a task together, at least.
TOGETHER = 10_000


def located(rows: DataFrame, cfg: PeakConfig) -> DataFrame:
    """Peaks with the seconds and hertz of their cells."""
    return rows.select("track_name", "frame", "bin", W.frame_time(F.col("frame"), cfg.time_per_frame).alias("time"), W.bin_freq(F.col("bin"), cfg.freq_per_bin).alias("freq"), F.col("db").alias("amplitude"))


def above_threshold(cells: DataFrame, cfg: PeakConfig) -> DataFrame:
    """Cells at or above the threshold; one that is not a number passes."""
    return cells.filter(F.isnan("db") | (F.col("db") >= F.lit(cfg.threshold_db).cast("float")))


def peaks_from_cells(cells: DataFrame, cfg: PeakConfig) -> DataFrame:
    """Peaks of a dense grid by window maxima: over the row beside a cell, and over the rows before
    and after of each row's own neighbourhood maximum. The threshold comes last, since the windows
    need every cell."""
    t, f = cfg.time_neighborhood, cfg.freq_neighborhood
    low = F.lit(float("-inf")).cast("float")
    level = F.nanvl(F.col("db"), low)
    row = Window.partitionBy("track_name", "frame").orderBy("bin")
    column = Window.partitionBy("track_name", "bin").orderBy("frame")

    def most(x: Column, window: Window, lo: int, hi: int) -> Column:
        return F.coalesce(F.max(x).over(window.rowsBetween(lo, hi)), low)

    rows = cells.withColumn("level", level)
    rivals = []
    if f:
        rows = rows.withColumn("beside", F.greatest(most(F.col("level"), row, -f, -1), most(F.col("level"), row, 1, f)))
        rivals.append(F.col("beside"))
    rows = rows.withColumn("near", most(F.col("level"), row, -f, f))
    if t:
        rows = rows.withColumn("around", F.greatest(most(F.col("near"), column, -t, -1), most(F.col("near"), column, 1, t)))
        rivals.append(F.col("around"))
    strict = F.lit(True)
    for rival in rivals:
        strict = strict & (F.col("level") > rival)
    rows = rows.filter(F.isnan("db") | ((F.col("db") >= F.lit(cfg.threshold_db).cast("float")) & strict))
    return located(rows.select("track_name", "frame", "bin", "db"), cfg)


def peaks_from_signals(signals: DataFrame, cfg: PipelineConfig, read: Callable[[pa.Scalar], np.ndarray] | None = None) -> DataFrame:
    """Peaks of whole tracks in one pass: spectra and maxima are found run by run where the samples
    are, and only peaks leave the task. `read` gives the samples of what the column `samples` holds,
    if that is no array of them."""
    cfg.spectrogram.check()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr, fr = np.float32(cfg.peaks.time_per_frame), np.float32(cfg.peaks.freq_per_bin)
        weights, found, held = np.array(W.hann_weights(cfg.spectrogram.window_size), np.float32), [], 0

        def full() -> pa.RecordBatch:
            names, parts = [name for name, *_ in found], [np.concatenate(x) for x in zip(*(part for _, *part in found), strict=True)]
            which = np.repeat(np.arange(len(found), dtype=np.int32), [len(part[1]) for part in found])
            frame, bin_, db = parts
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(which)), *(pa.array(x) for x in (frame.astype(np.int32), bin_.astype(np.int32), frame.astype(np.float32) * tr, bin_.astype(np.float32) * fr, db))], ["track_name", "frame", "bin", "time", "freq", "amplitude"])

        for batch in batches:
            for name, samples in zip(batch.column(0), batch.column(1), strict=True):
                if not samples.is_valid:
                    continue
                for frame, bin_, db in track_peaks(read(samples) if read else samples.values.to_numpy(zero_copy_only=False), cfg, weights):
                    if len(frame):
                        found.append((name.as_py(), frame, bin_, db))
                        held += len(frame)
                    # The peaks of many short tracks leave together.
                    if held >= TOGETHER:
                        yield full()
                        found, held = [], 0
        if found:
            yield full()

    return signals.select("track_name", "samples").mapInArrow(run, schemas.PEAKS)


def sequenced(peaks: DataFrame) -> DataFrame:
    """Adds seq, the place of a peak in its track's order of time and frequency."""
    order = ["time", "frame", "bin"] if "frame" in peaks.columns else ["time", "freq"]
    return peaks.withColumn("seq", F.row_number().over(Window.partitionBy("track_name").orderBy(*order)) - 1)
