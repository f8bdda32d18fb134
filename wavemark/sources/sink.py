"""`df.write.format("wave_index")`: fingerprints (track_name, hash, anchor_time) into an index on disk.

Tasks write Parquet files into a folder of their own beside the index. When all have ended, the driver
keeps the files that successful tasks named, and one rename makes them a segment; a write that fails
or is aborted leaves nothing. A segment belongs to the index from then on: whoever opens it next
through `opened` takes its rows in, and the pointer that does so names the segment, so that it counts
once even if a writer dies in between. For folders that executors can open.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..config import IndexConfig
from ..operators.index import FingerprintIndex
from . import store
from .datasource import local

#: The columns that are written.
COLUMNS = "track_name string, hash bigint, anchor_time float"
STAGED, SEGMENT, ANEW = ".staged-", "incoming-", "-anew"


@dataclass
class Written(WriterCommitMessage):
    """The file of a task, or none if it had no rows."""

    file: str | None


class IndexWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = local(path).rstrip("/"), overwrite
        self.staged = f"{self.path}/{STAGED}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.staged, exist_ok=True)
        file, out = f"{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            rows = pa.table({"track_name": batch.column("track_name").cast(pa.string()), "hash": batch.column("hash").cast(pa.int64()), "anchor_time": batch.column("anchor_time").cast(pa.float32())})
            out = out or pq.ParquetWriter(f"{self.staged}/{file}", rows.schema)
            out.write_table(rows)
        if out is None:
            return Written(None)
        out.close()
        return Written(file)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.staged, exist_ok=True)
        kept = {m.file for m in messages if m is not None and m.file}
        for file in set(os.listdir(self.staged)) - kept:
            os.remove(f"{self.staged}/{file}")  # of tasks that were run again
        # Names sort by time, which is the order in which segments are taken in.
        os.rename(self.staged, f"{self.path}/{SEGMENT}{time.time_ns():020d}-{uuid.uuid4().hex}{ANEW if self.overwrite else ''}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


class IndexDataSource(DataSource):
    """Modes: append adds to the index, overwrite makes it hold these fingerprints alone."""

    @classmethod
    def name(cls) -> str:
        return "wave_index"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        missing = {"track_name", "hash", "anchor_time"} - set(schema.names)
        if missing:
            raise ValueError(f"wave_index needs the columns {', '.join(sorted(missing))}")
        return IndexWriter(self.options["path"], overwrite)


def segments(spark: SparkSession, path: str) -> list[str]:
    """Segments that no pointer has taken in, oldest first."""
    held = store.Store(spark, path)
    taken = set(held.latest()[1].get("segments", []))
    return sorted(x for x in held.children() if x.startswith(SEGMENT) and x not in taken)


def absorb(spark: SparkSession, path: str, layout: store.Layout | None = None) -> int:
    """Takes all segments into the index, each as one commit, and says how many."""
    held, done = store.Store(spark, path), 0
    for name in segments(spark, path):
        rows: DataFrame = spark.read.schema(COLUMNS).parquet(f"{held.path}/{name}")
        try:
            if name.endswith(ANEW):
                config = IndexConfig(held.latest()[1]["offset_bin_size"])
                store.save(FingerprintIndex.build(rows, config), path, layout, segment=name)
            else:
                store.append(spark, path, rows, layout=layout, segment=name)
            done += 1
        except store.SegmentTaken:
            continue
    for name in set(held.latest()[1].get("segments", [])) & set(held.children()):
        held.drop(name)
    return done


def opened(spark: SparkSession, path: str) -> FingerprintIndex:
    """The index with all segments taken in."""
    absorb(spark, path)
    return store.load(spark, path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexDataSource)
