"""Constellations to fingerprints: each peak as an anchor with the next peaks as targets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as W
from .. import schemas
from ..config import HashConfig, PipelineConfig
from .dsp import track_peaks
from .peaks import TOGETHER, peaks_from_signals, sequenced


def hashed(pairs: DataFrame, cfg: HashConfig) -> DataFrame:
    """Fingerprints of (track_name, seq, time, freq, other, dt) rows; `other` is the target."""
    f1 = W.freq_to_bin(F.col("freq"), cfg.freq_resolution, cfg.freq_bins)
    f2 = W.freq_to_bin(F.col("other.freq"), cfg.freq_resolution, cfg.freq_bins)
    return pairs.select("track_name", F.col("seq").cast("int").alias("seq"), W.pack_hash(f1, f2, W.quantize_dt(F.col("dt"), cfg.dt_resolution)).alias("hash"), F.col("time").alias("anchor_time"))


def fan_pairs(peaks: DataFrame, cfg: HashConfig) -> DataFrame:
    """Pairs when no target is skipped (min_dt of 0 at most): the next `fan` peaks of the anchor's
    window frame are the only candidates, and no join is needed."""
    ahead = Window.partitionBy("track_name").orderBy("seq").rowsBetween(1, cfg.fan_value)
    rows = sequenced(peaks).withColumn("targets", F.collect_list(F.struct("time", "freq")).over(ahead))
    rows = rows.select("track_name", "seq", "time", "freq", F.explode("targets").alias("other"))
    return rows.withColumn("dt", F.col("other.time") - F.col("time")).filter(F.col("dt") <= F.lit(cfg.max_dt).cast("float"))


def range_pairs(peaks: DataFrame, cfg: HashConfig) -> DataFrame:
    """Pairs at least min_dt and at most max_dt apart: a band join on slots of time a little wider
    than max_dt, each target standing in its own slot and the one before, then the first `fan` of
    each anchor. Targets that are too near do not use up the fan."""
    rows = sequenced(peaks).select("track_name", "seq", "time", "freq")
    dt = F.col("other.time") - F.col("time")
    near = (F.col("other.seq") > F.col("seq")) & (dt >= F.lit(cfg.min_dt).cast("float")) & (dt <= F.lit(cfg.max_dt).cast("float"))
    if math.isfinite(cfg.max_dt) and cfg.max_dt > 0:
        slot = F.floor(F.col("time") / F.lit(cfg.max_dt * 1.001)).cast("long")
        targets = rows.select(F.col("track_name"), F.struct("seq", "time", "freq").alias("other"), F.explode(F.array(slot, slot - 1)).alias("slot"))
        rows = rows.withColumn("slot", slot).join(targets, ["track_name", "slot"])
    else:
        rows = rows.join(rows.select("track_name", F.struct("seq", "time", "freq").alias("other")), "track_name")
    order = Window.partitionBy("track_name", "seq").orderBy("other.seq")
    return rows.filter(near).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cfg.fan_value).withColumn("dt", dt)


def fingerprints(peaks: DataFrame, cfg: HashConfig) -> DataFrame:
    """(track_name, seq, hash, anchor_time); seq is the anchor's."""
    if cfg.fan_value <= 0:
        return hashed(fan_pairs(peaks, HashConfig(fan_value=1)), cfg).filter(F.lit(False))
    return hashed(fan_pairs(peaks, cfg) if cfg.min_dt <= 0 else range_pairs(peaks, cfg), cfg)


def rounded(x: np.ndarray, most: int) -> np.ndarray:
    """Rounded half away from zero, not below 0 or above `most`."""
    return np.clip(np.floor(x.astype(np.float64) + 0.5), 0, most).astype(np.int64)


def track_hashes(frame: np.ndarray, bin_: np.ndarray, cfg: PipelineConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """seq, hash and anchor time of a track's pairs, from its peaks in order; min_dt is 0 at most.
    The k-th targets of all anchors are paired at once."""
    h, n = cfg.hashes, len(frame)
    time = frame.astype(np.float32) * np.float32(cfg.peaks.time_per_frame)
    freq = rounded(bin_.astype(np.float32) * np.float32(cfg.peaks.freq_per_bin) / np.float32(h.freq_resolution), h.freq_bins - 1)
    seqs, hashes = [], []
    for k in range(1, min(h.fan_value, n - 1) + 1):
        dt = time[k:] - time[:-k]
        i = np.flatnonzero(dt <= np.float32(h.max_dt))
        if not len(i):
            break
        q = rounded(dt[i] / np.float32(h.dt_resolution), W.U32_MAX)
        seqs.append(i)
        hashes.append((freq[i] & W.FIELD_MASK) << 40 | (freq[i + k] & W.FIELD_MASK) << 20 | q & W.FIELD_MASK)
    seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int64)
    return seq.astype(np.int32), np.concatenate(hashes) if hashes else np.zeros(0, np.int64), time[seq]


def fingerprints_from_signals(signals: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Fingerprints of whole tracks in one pass over their samples. With a min_dt, whose pairs need
    the band join, peaks are found in that pass and paired after it."""
    if cfg.hashes.min_dt > 0 or cfg.hashes.fan_value <= 0:
        return fingerprints(peaks_from_signals(signals, cfg), cfg.hashes)
    cfg.spectrogram.check()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, found, held = np.array(W.hann_weights(cfg.spectrogram.window_size), np.float32), [], 0

        def full() -> Iterator[pa.RecordBatch]:
            which = np.repeat(np.arange(len(found), dtype=np.int32), [len(x[1]) for x in found])
            names, (seq, hash_, time) = pa.array([x[0] for x in found], pa.string()), (np.concatenate(x) for x in list(zip(*found, strict=True))[1:])
            for i in range(0, len(seq), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(which[part])), pa.array(seq[part]), pa.array(hash_[part]), pa.array(time[part])], ["track_name", "seq", "hash", "anchor_time"])

        for batch in batches:
            for name, samples in zip(batch.column(0), batch.column(1), strict=True):
                samples = samples.values.to_numpy(zero_copy_only=False) if samples.is_valid else np.zeros(0, np.float32)
                runs = [(f, b) for f, b, _ in track_peaks(samples, cfg, weights)]
                if runs:
                    found.append((name.as_py(), *track_hashes(*(np.concatenate(x) for x in zip(*runs, strict=True)), cfg)))
                    held += len(found[-1][1])
                # The fingerprints of many short tracks leave together.
                if held >= TOGETHER or len(found) >= TOGETHER:
                    yield from full()
                    found, held = [], 0
        if found:
            yield from full()

    return signals.select("track_name", "samples").mapInArrow(run, schemas.FINGERPRINTS)
