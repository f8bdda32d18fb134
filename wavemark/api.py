"""Plain Python objects over the DataFrame pipeline, for one file or a few."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession

from . import schemas
from .config import IndexConfig, PipelineConfig
from .functions import python_hash
from .operators.index import FingerprintIndex
from .plans import as_queries, fingerprint
from .sources import store
from .sources.wav import load_wav

Prints = list[tuple[int, float]]


class Fingerprinter:
    """Fingerprints WAV files as lists of (hash, anchor_time)."""

    def __init__(self, spark: SparkSession | None = None, config: PipelineConfig | None = None) -> None:
        self.spark, self.config = spark or SparkSession.builder.getOrCreate(), config or PipelineConfig()

    def fingerprint_file(self, path: str) -> Prints:
        audio = load_wav(path)
        self.config.spectrogram.check()
        self.config.spectrogram.check_length(len(audio.samples))
        samples = pa.ListArray.from_arrays(pa.array([0, len(audio.samples)], pa.int32()), pa.array(audio.samples, pa.float32()))
        signal = self.spark.createDataFrame(pa.table({"track_name": pa.array(["file"]), "samples": samples, "sample_rate": pa.array([audio.sample_rate], pa.int32()), "original_channels": pa.array([audio.original_channels], pa.int16())}))
        rows = fingerprint(signal, self.config).orderBy("seq", "hash").collect()
        return [(r["hash"], r["anchor_time"]) for r in rows]


class Index:
    """A mutable index. Inserts are gathered and join the tables when something is asked."""

    def __init__(self, spark: SparkSession | None = None, config: IndexConfig | None = None, held: FingerprintIndex | None = None) -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()
        self._held = held or FingerprintIndex.empty(self.spark, config)
        self._names: list[tuple[str]] = []
        self._rows: list[tuple[str, int, int, float]] = []

    def insert(self, track_id: str, fingerprints: Prints) -> None:
        """Adds to a track; nothing is deduplicated."""
        self._names.append((track_id,))
        self._rows += [(track_id, i, python_hash(h), float(t)) for i, (h, t) in enumerate(fingerprints)]

    def insert_batch(self, tracks: list[tuple[str, Prints]]) -> None:
        for name, prints in tracks:
            self.insert(name, prints)

    @property
    def tables(self) -> FingerprintIndex:
        if self._names:
            rows = self.spark.createDataFrame(self._rows, schemas.FINGERPRINTS)
            self._held = self._held.insert(rows, self.spark.createDataFrame(self._names, "track_name string"))
            self._names, self._rows = [], []
        return self._held

    def query(self, fingerprints: Prints) -> dict | None:
        """track_id, score and offset_secs of the best track, or None."""
        if not fingerprints:
            return None
        rows = self.spark.createDataFrame([("q", 0, python_hash(h), float(t)) for h, t in fingerprints], schemas.FINGERPRINTS)
        found = self.tables.query_batch(as_queries(rows)).first()
        return found and {k: found[k] for k in ("track_id", "score", "offset_secs")}

    @property
    def track_count(self) -> int:
        return self.tables.track_count()

    @property
    def hash_count(self) -> int:
        return self.tables.hash_count()

    def save(self, path: str) -> None:
        store.save(self.tables, path)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Index:
        spark = spark or SparkSession.builder.getOrCreate()
        return cls(spark, held=store.load(spark, path))
