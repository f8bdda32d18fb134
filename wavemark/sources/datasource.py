"""WAV files of a folder as data sources of Spark, for folders that executors can open (`read_wavs`
reads any store Spark can).

`wave` gives whole files, a partition each, and streams: files that arrive are read once each, in the
order they came, and a restart goes on after the last batch. `wave_chunks` cuts files in runs of
frames, a partition each, and reads only the bytes of the run and what it has to carry around it.
"""

from __future__ import annotations

import glob
import os
import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import schemas
from ..config import PipelineConfig
from ..errors import FileNotFound, WaveError
from ..operators.chunks import FRAMES, spans
from ..operators.dsp import frame_total
from .riff import Form, located, samples_between
from .wav import load_wav, track_name


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def files_of(path: str) -> list[str]:
    """A file of any name, or the WAV files directly in a folder."""
    path = local(path)
    if not os.path.exists(path):
        raise FileNotFound(path)
    return [path] if os.path.isfile(path) else sorted(f for f in glob.glob(f"{glob.escape(path)}/*") if f.lower().endswith(".wav") and os.path.isfile(f))


def whole(path: str) -> pa.RecordBatch:
    out = load_wav(path)
    samples = pa.ListArray.from_arrays(pa.array([0, len(out.samples)], pa.int32()), pa.array(out.samples, pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array([track_name(path)]), samples, pa.array([out.sample_rate], pa.int32()), pa.array([out.original_channels], pa.int16())], ["track_name", "samples", "sample_rate", "original_channels"])


class WaveReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in files_of(self.path)]

    def read(self, partition: InputPartition):
        yield whole(partition.value)


class WaveStreamReader(DataSourceStreamReader):
    """Offsets are the time and name of the last file taken; a batch holds the files between two. The time
    is that of the file's last change of place or state, which no copy of old times sets back, so files
    sort as they arrive. One younger than `settle` waits for the next batch, since a listing may miss
    another that came just before it. Files have to be moved into the folder whole."""

    def __init__(self, path: str, settle: float) -> None:
        self.path, self.settle, self.last = path, settle, (-1, "")

    def arrived(self) -> list[tuple[int, str]]:
        if not os.path.exists(local(self.path)):
            return []
        return sorted((os.stat(f).st_ctime_ns, f) for f in files_of(self.path))

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        now = time.time_ns() - int(self.settle * 1e9)
        self.last = max([self.last, *(x for x in self.arrived() if x[0] <= now)])
        return {"time": self.last[0], "file": self.last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = (start["time"], start["file"]), (end["time"], end["file"])
        return [InputPartition(f) for t, f in self.arrived() if lo < (t, f) <= hi]

    def read(self, partition: InputPartition):
        try:
            yield whole(partition.value)
        except WaveError:
            # A stream goes on past a file that is none; the batch reader tells its error.
            return

    def commit(self, end: dict) -> None:
        """Nothing is held back for a batch that is done."""


class WaveDataSource(DataSource):
    """Options: path; settle, the seconds that a stream waits before it takes a file (1)."""

    @classmethod
    def name(cls) -> str:
        return "wave"

    def schema(self) -> str:
        return schemas.SIGNALS

    def reader(self, schema) -> DataSourceReader:
        return WaveReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return WaveStreamReader(self.options["path"], float(self.options.get("settle", 1)))


@dataclass
class Run(InputPartition):
    """Frames first..last-1 of a file, and the samples to be read for them; or what is wrong with it."""

    path: str
    form: Form | None = None
    at: int = 0
    first: int = 0
    last: int = 0
    start: int = 0
    samples: tuple[int, int] = (0, 0)
    error: str | None = None


class WaveChunkReader(DataSourceReader):
    def __init__(self, path: str, cfg: PipelineConfig, frames: int, strict: bool) -> None:
        self.path, self.cfg, self.frames, self.strict = path, cfg, frames, strict

    def partitions(self) -> list[InputPartition]:
        return [run for f in files_of(self.path) for run in self.runs(f)]

    def runs(self, path: str) -> list[Run]:
        """Only the heads of a file's chunks are read here."""
        window, hop = self.cfg.spectrogram.window_size, self.cfg.spectrogram.hop_size
        try:
            with open(path, "rb") as f:
                form, at, n = located(f, path)
        except WaveError as e:
            if self.strict:
                raise
            return [Run(path, error=str(e))]
        cut = spans(frame_total(n, window, hop), self.cfg, self.frames)
        return [Run(path, form, at, first, last, start, (start * hop, (end - 1) * hop + window)) for first, last, start, end in cut]

    def read(self, partition: Run):
        samples = None
        if not partition.error:
            with open(partition.path, "rb") as f:
                values = samples_between(f, partition.form, partition.at, *partition.samples, partition.path)
            samples = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.float32()))
        frames = [pa.array([x], pa.int64()) for x in (partition.first, partition.last, partition.start)]
        columns = [pa.array([track_name(partition.path)]), pa.array([partition.path]), *frames, samples or pa.array([None], pa.list_(pa.float32())), pa.array([partition.error], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["track_name", "path", "first", "last", "start", "samples", "error"])


class WaveChunkDataSource(DataSource):
    """Options: path; frames, those that a partition owns; windowSize, hopSize, timeNeighborhood and
    maxDt, which say what it carries; mode, permissive (a bad file is a row with its error) or strict."""

    @classmethod
    def name(cls) -> str:
        return "wave_chunks"

    def schema(self) -> str:
        return f"{schemas.CHUNKS}, error string"

    def reader(self, schema) -> DataSourceReader:
        o, base = self.options, PipelineConfig()
        cfg = PipelineConfig.derive(
            window_size=int(o.get("windowSize", base.spectrogram.window_size)), hop_size=int(o.get("hopSize", base.spectrogram.hop_size)),
            peaks={"time_neighborhood": int(o.get("timeNeighborhood", base.peaks.time_neighborhood)), "sample_rate": int(o.get("sampleRate", base.peaks.sample_rate))}, hashes={"max_dt": float(o.get("maxDt", base.hashes.max_dt))},
        )
        cfg.spectrogram.check()
        return WaveChunkReader(o["path"], cfg, int(o.get("frames", FRAMES)), o.get("mode", "permissive") == "strict")


def chunk_options(cfg: PipelineConfig, frames: int = FRAMES) -> dict[str, str]:
    """Options of `wave_chunks` for these settings."""
    values = {"frames": frames, "windowSize": cfg.spectrogram.window_size, "hopSize": cfg.spectrogram.hop_size, "timeNeighborhood": cfg.peaks.time_neighborhood, "sampleRate": cfg.peaks.sample_rate, "maxDt": cfg.hashes.max_dt}
    return {k: str(v) for k, v in values.items()}


def register(spark: SparkSession) -> None:
    for source in (WaveDataSource, WaveChunkDataSource):
        spark.dataSource.register(source)
