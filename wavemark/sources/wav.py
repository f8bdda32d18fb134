"""WAV files as signals: a file, a folder, or a stream of files."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import FileNotFound, FileNotReadable, StoreIoError, UnsupportedAudioFormat, WaveError
from ..shared import hadoop_path
from .riff import Decoded, decode

#: Extensions of the files that can be read.
EXTENSIONS = ("wav",)
#: Names of WAV files in a folder, in any case.
WAV_NAMES = "*.[wW][aA][vV]"


class SignalSource(Protocol):
    """Anything that gives the samples of one signal."""

    def read(self) -> np.ndarray: ...


def validate_audio_file(path: str) -> str:
    """The real path of a local file that exists, has a known extension in any case, and opens."""
    if not os.path.exists(path):
        raise FileNotFound(path)
    extension = os.path.splitext(path)[1][1:].lower()
    if not extension:
        raise UnsupportedAudioFormat("file has no extension")
    if extension not in EXTENSIONS:
        raise UnsupportedAudioFormat(f"'.{extension}' is not a supported audio format")
    try:
        with open(path, "rb"):
            pass
    except OSError as e:
        raise FileNotReadable(f"{path}: {e}") from e
    try:
        return os.path.realpath(path, strict=True)
    except OSError as e:
        raise StoreIoError(f"{path}: {e}") from e


def load_wav(path: str) -> Decoded:
    """Decodes one local file on the driver."""
    if not os.path.exists(path):
        raise FileNotFound(path)
    try:
        with open(path, "rb") as f:
            data = f.read()
    except OSError as e:
        raise FileNotReadable(f"{path}: {e}") from e
    return decode(data, path)


class FileSource:
    """A SignalSource of one local file."""

    def __init__(self, path: str) -> None:
        self.path = path

    def read(self) -> np.ndarray:
        return load_wav(validate_audio_file(self.path)).samples


def track_name(path: str) -> str:
    """A file's name without its extension."""
    return os.path.splitext(path.rsplit("/", 1)[-1])[0]


def decoded(files: DataFrame, strict: bool = False, checksum: bool = False) -> DataFrame:
    """Signals from (path, content) rows. Unless strict, a file that cannot be decoded has no
    samples, and its error in a column; strict fails on it. `checksum` adds the SHA-256 of the bytes,
    taken while they are at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    out, error = decode(content.as_py(), path), None
                except WaveError as e:
                    if strict:
                        raise
                    out, error = None, str(e)
                samples = pa.ListArray.from_arrays(pa.array([0, len(out.samples)], pa.int32()), pa.array(out.samples, pa.float32())) if out else pa.array([None], pa.list_(pa.float32()))
                rest = ((out and out.sample_rate, pa.int32()), (out and out.original_channels, pa.int16()), (path, pa.string()), (error, pa.string()))
                if checksum:
                    rest += ((hashlib.sha256(content.as_buffer()).hexdigest(), pa.string()),)
                yield pa.RecordBatch.from_arrays([pa.array([track_name(path)]), samples, *(pa.array([x], t) for x, t in rest)], names)

    names = ["track_name", "samples", "sample_rate", "original_channels", "path", "error", *(["checksum"] if checksum else [])]
    return files.select("path", "content").mapInArrow(run, schemas.SIGNALS_PERMISSIVE + (", checksum string" if checksum else ""))


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a file of any name, or of the WAV files directly in a folder."""
    at, store = hadoop_path(spark, path)
    pattern = any(c in path for c in "*?[{")
    if not pattern and not store.exists(at):
        raise FileNotFound(path)
    reader = spark.read.format("binaryFile")
    if store.exists(at) and store.getFileStatus(at).isFile():
        return reader.load(path)
    return reader.option("pathGlobFilter", WAV_NAMES).load(path)


def read_wavs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return decoded(wav_files(spark, path), strict)


def good(signals: DataFrame) -> DataFrame:
    return signals.filter(F.col("error").isNull()).drop("path", "error", "checksum")


def failed(signals: DataFrame) -> DataFrame:
    return signals.filter(F.col("error").isNotNull()).select("track_name", "path", "error")
