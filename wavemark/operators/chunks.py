"""Long tracks in chunks: runs of frames that carry the samples around them, so that each is worked on
in a task of its own and the results are those of the whole track.

A chunk owns frames first..last-1. Before them it carries as many frames as a peak's neighbourhood
reaches; after them also those in which the last anchor's targets may lie, and their neighbourhoods.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as W
from .. import schemas
from ..config import PipelineConfig
from ..shared import written
from .dsp import track_peaks
from .hashes import fingerprints, track_hashes

#: Frames that a chunk owns unless told otherwise: three minutes by default settings.
FRAMES = 8_192


def margins(cfg: PipelineConfig) -> tuple[int, int]:
    """Frames a chunk carries before and after its own."""
    t, ahead = cfg.peaks.time_neighborhood, 0
    if math.isfinite(cfg.hashes.max_dt) and cfg.hashes.max_dt > 0:
        ahead = int(cfg.hashes.max_dt / cfg.peaks.time_per_frame) + 2
    return t, ahead + t


def spans(total: int, cfg: PipelineConfig, frames: int) -> Iterator[tuple[int, int, int, int]]:
    """first, last, start and end, in frames, of the chunks of a track of `total` frames."""
    before, after = margins(cfg)
    for first in range(0, total, frames):
        last = min(total, first + frames)
        yield first, last, max(0, first - before), min(total, last + after)


def split_signals(signals: DataFrame, cfg: PipelineConfig, frames: int = FRAMES) -> DataFrame:
    """Chunks of signals (track_name, samples) that are rows already, dealt anew. Names have to be
    those of one signal each."""
    cfg.spectrogram.check()
    window, hop = cfg.spectrogram.window_size, cfg.spectrogram.hop_size
    before, after = margins(cfg)
    total = W.frame_count(F.col("samples"), window, hop).cast("long")
    rows = signals.select("track_name", "samples", total.alias("n")).filter("n > 0")
    rows = rows.select("track_name", "samples", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(frames).cast("long"))).alias("first"))
    rows = rows.withColumn("last", F.least("n", F.col("first") + frames)).withColumn("start", F.greatest(F.lit(0), F.col("first") - before))
    length = (F.least("n", F.col("last") + after) - F.col("start") - 1) * hop + window
    samples = F.slice("samples", (F.col("start") * hop + 1).cast("int"), length.cast("int"))
    return rows.select("track_name", F.col("track_name").alias("path"), "first", "last", "start", samples.alias("samples")).repartition("track_name", "first")


def chunk_peaks(samples: np.ndarray, start: int, first: int, last: int, cfg: PipelineConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames, bins and levels of a track's peaks in frames first..last-1."""
    found = list(track_peaks(samples, cfg))
    frame, bin_, db = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    frame = frame + start
    own = (first <= frame) & (frame < last)
    return frame[own], bin_[own], db[own]


def chunk_rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str, int, int, int, np.ndarray]]:
    for i in range(batch.num_rows):
        name, path, first, last, start = (batch.column(c)[i].as_py() for c in range(5))
        yield name, path, first, last, start, batch.column(5)[i].values.to_numpy(zero_copy_only=False)


def peaks_from_chunks(chunks: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Peaks of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr, fr = np.float32(cfg.peaks.time_per_frame), np.float32(cfg.peaks.freq_per_bin)
        for batch in batches:
            for name, _, first, last, start, samples in chunk_rows(batch):
                frame, bin_, db = chunk_peaks(samples, start, first, last, cfg)
                columns = [pa.array([name] * len(frame), pa.string()), *(pa.array(x) for x in (frame.astype(np.int32), bin_.astype(np.int32), frame.astype(np.float32) * tr, bin_.astype(np.float32) * fr, db))]
                yield pa.RecordBatch.from_arrays(columns, ["track_name", "frame", "bin", "time", "freq", "amplitude"])

    return chunks.filter("samples is not null").select("track_name", "path", "first", "last", "start", "samples").mapInArrow(run, schemas.PEAKS)


def local_prints(chunks: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """(track_name, path, first, seq, hash, anchor_time) of the anchors that chunks own, numbered inside
    their chunk, and for each chunk a row without a fingerprint whose seq is the number of its peaks.
    Pairs need no other chunk, so this works on a stream of chunks too."""
    names = ["track_name", "path", "first", "seq", "hash", "anchor_time"]
    ahead = margins(cfg)[1] - cfg.peaks.time_neighborhood

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, path, first, last, start, samples in chunk_rows(batch):
                frame, bin_, _ = chunk_peaks(samples, start, first, last + ahead, cfg)
                own = int((frame < last).sum())
                seq, hash_, time = track_hashes(frame, bin_, cfg)
                mine = seq < own
                seq, hash_, time = np.r_[own, seq[mine]], np.r_[0, hash_[mine]], np.r_[np.float32(0), time[mine]]
                n, told = len(seq), np.arange(len(seq)) == 0
                columns = [pa.array([name] * n, pa.string()), pa.array([path] * n, pa.string()), pa.array(np.full(n, first)), pa.array(seq.astype(np.int64)), pa.array(hash_.astype(np.int64), mask=told), pa.array(time.astype(np.float32))]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = chunks.filter("samples is not null").select("track_name", "path", "first", "last", "start", "samples")
    return rows.mapInArrow(run, "track_name string, path string, first bigint, seq bigint, hash bigint, anchor_time float")


def pairs_within(cfg: PipelineConfig) -> bool:
    """Whether a chunk carries all that its anchors pair with."""
    return cfg.hashes.min_dt <= 0 < cfg.hashes.fan_value and math.isfinite(cfg.hashes.max_dt) and cfg.hashes.max_dt > 0


def fingerprints_from_chunks(chunks: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Fingerprints of all chunks. To the number of an anchor in its chunk the peaks of the chunks
    before are added, which are one number a chunk."""
    if not pairs_within(cfg):
        return fingerprints(peaks_from_chunks(chunks, cfg), cfg.hashes)
    rows = written(local_prints(chunks, cfg), "chunk-prints")
    before = F.coalesce(F.sum("seq").over(Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.filter("hash is null").select("path", "first", before.alias("before"))
    return rows.filter("hash is not null").join(counts, ["path", "first"]).select("track_name", (F.col("before") + F.col("seq")).cast("int").alias("seq"), "hash", "anchor_time")
