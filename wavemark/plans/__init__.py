"""Whole pipelines over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators.hashes import fingerprints, fingerprints_from_signals
from ..operators.index import FingerprintIndex
from ..operators.peaks import peaks_from_cells
from ..operators.spectrogram import cells


def fingerprint(signals: DataFrame, cfg: PipelineConfig | None = None, native: bool = False) -> DataFrame:
    """Fingerprints of signals. The native form uses SQL operations alone and suits small windows."""
    cfg = cfg or PipelineConfig()
    if not native:
        return fingerprints_from_signals(signals, cfg)
    return fingerprints(peaks_from_cells(cells(signals, cfg.spectrogram), cfg.peaks), cfg.hashes)


def as_queries(prints: DataFrame) -> DataFrame:
    return prints.select(F.col("track_name").alias("query_id"), "hash", "anchor_time")


def identify(signals: DataFrame, index: FingerprintIndex, cfg: PipelineConfig | None = None, min_score: int = 10) -> DataFrame:
    """The best track of each signal, with a status."""
    names = signals.select(F.col("track_name").alias("query_id"))
    return index.identify(as_queries(fingerprint(signals, cfg)), names, min_score)
