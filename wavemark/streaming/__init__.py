"""Identification of files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import PipelineConfig
from ..operators.index import FingerprintIndex
from ..plans import identify
from ..sources.wav import WAV_NAMES, decoded, good

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", WAV_NAMES).load(folder)


def identify_stream(files: DataFrame, index: FingerprintIndex, sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: PipelineConfig | None = None, min_score: int = 10) -> StreamingQuery:
    """Identifies each micro-batch of files against a fixed index and hands the rows to `sink` with
    the batch's number; a sink that writes by that number makes each file count once."""

    def batch(files: DataFrame, number: int) -> None:
        signals = good(decoded(files.select("path", "content")))
        sink(identify(signals, index, cfg, min_score), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
