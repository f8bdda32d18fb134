"""Table functions for SQL: rows of a spectrogram from tracks that come whole or in pieces.

    SELECT * FROM wave_spectrogram(TABLE(SELECT track_name, samples, place FROM pieces)
        PARTITION BY track_name ORDER BY (place), 2048, 512)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from .. import schemas
from ..config import SpectrogramConfig
from ..operators.dsp import FRAMES, frame_total, spectrum_db
from . import hann_weights


class PiecewiseSpectrogram:
    """Levels of a track whose samples come piece by piece: what the next frame needs of the pieces
    before is kept, which is less than a window."""

    def __init__(self, window: int, hop: int) -> None:
        SpectrogramConfig(window, hop).check()
        self.window, self.hop, self.weights = window, hop, np.array(hann_weights(window), np.float32)
        self.rest, self.frame, self.skip = np.zeros(0, np.float32), 0, 0

    def add(self, samples: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first frame, levels) of the frames that this piece completes."""
        skipped = min(self.skip, len(samples))
        self.skip -= skipped
        held = np.concatenate([self.rest, samples[skipped:]])
        total = frame_total(len(held), self.window, self.hop)
        for first in range(0, total, FRAMES):
            last = min(total, first + FRAMES)
            yield self.frame + first, spectrum_db(held, self.window, self.hop, first, last, self.weights)
        used = total * self.hop
        self.frame, self.skip, self.rest = self.frame + total, self.skip + max(0, used - len(held)), held[used:].copy()


class SpectrogramRows:
    """Rows (track_name, frame, db) of a table with track_name and samples; a null samples is an empty
    piece. Partitions hold tracks, ordered by the place of their pieces."""

    def __init__(self) -> None:
        self.name, self.track = None, None

    def eval(self, rows: pa.RecordBatch, window: pa.Array, hop: pa.Array) -> Iterator[pa.RecordBatch]:
        size, step = window[0].as_py(), hop[0].as_py()
        for name, samples in zip(rows.column("track_name").to_pylist(), rows.column("samples"), strict=True):
            if self.track is None or name != self.name:
                self.name, self.track = name, PiecewiseSpectrogram(size, step)
            piece = samples.values.to_numpy(zero_copy_only=False).astype(np.float32) if samples.is_valid else np.zeros(0, np.float32)
            for first, db in self.track.add(piece):
                offsets = np.arange(len(db) + 1, dtype=np.int32) * db.shape[1]
                levels = pa.ListArray.from_arrays(pa.array(offsets), pa.array(db.reshape(-1), pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(db), pa.string()), pa.array(np.arange(first, first + len(db), dtype=np.int32)), levels], ["track_name", "frame", "db"])


def register_tables(spark: SparkSession) -> None:
    """Makes wave_spectrogram(TABLE, window, hop) available to SQL of this session."""
    spark.udtf.register("wave_spectrogram", arrow_udtf(SpectrogramRows, returnType=schemas.SPECTROGRAM))
