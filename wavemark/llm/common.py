"""What the text operators share: scratch tables, words, hashes and checked broadcasts.

Words are runs of bytes other than ASCII white space. ``bytes.split()`` cuts at exactly the
bytes 0x20 and 0x09 to 0x0D, which is the class ``[\\x20\\x09-\\x0D]``, and ``bytes.lower()``
changes A-Z only, so Python code works on the UTF-8 bytes and agrees with the SQL pattern.
"""

from __future__ import annotations

import pickle
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import forget, fresh_path, shared_dir, written  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"

#: Odd multipliers for mixing hashes of neighbouring words; any odd 64-bit values do.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def free_name(name: str, taken: list[str]) -> str:
    """`name`, or name_1, name_2, ...: the first that no column has in any case of letters."""
    used = {x.lower() for x in taken}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(1, len(used) + 2))) if x.lower() not in used)


def whole_row(df: DataFrame) -> Column:
    """All columns of a table as one, `row`, so that no name in it meets one that an operator adds."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row")


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like `written`, with the rows of a key in one of `buckets` buckets, so that grouping by the key
    or joining on it does not shuffle them."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    known = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(known)
    out = spark.table(known)
    out.scratch_path, out.scratch_name = path, known
    return out


def forget_bucketed(t: DataFrame) -> None:
    """Deletes a table of `bucketed` that nothing will read again."""
    t.sparkSession.sql(f"DROP TABLE {t.scratch_name}")
    forget(t)


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """The rows with, for each name in `sums`, the sum of its column over all rows before, and, as all_ and
    the name, over all rows. Rows are written in ranges of the order: a task sums inside its range,
    and one row a range gives the sums of the ranges before. Rows that tie in the order count in any."""
    ranged = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), name)
    totals = ranged.groupBy("__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy().orderBy("__range")
    starts = [(F.sum(n).over(before) - F.col(n)).alias(f"__from_{n}") for n in sums]
    totals = totals.select("__range", *starts, *[F.sum(n).over(Window.partitionBy()).alias(f"all_{n}") for n in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *[(F.sum(c).over(inside) - F.col(c)).alias(f"__in_{n}") for n, c in sums.items()])
    # One row for each range, of which there are as many as the session has shuffle partitions.
    out = summed.join(F.broadcast(totals), "__range")
    return out.select(*rows.columns, *[(F.col(f"__from_{n}") + F.col(f"__in_{n}")).alias(n) for n in sums], *[f"all_{n}" for n in sums])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_of(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring word hashes; with fewer than k words, one hash of them all."""
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(min(k, len(h))), dtype=np.uint64)
    for i in range(min(k, len(h))):
        out = (out ^ h[i : i + n]) * _MIX[i % len(_MIX)]
        out ^= out >> np.uint64(29)
    return mix64(out)


def as_long(h: np.ndarray) -> np.ndarray:
    """64-bit patterns as Spark's signed long."""
    return h.view(np.int64)


class Shared:
    """A broadcast of an object whose code travels with it, so executors need not import it."""

    def __init__(self, broadcast) -> None:
        self._broadcast = broadcast

    @property
    def value(self):
        return pickle.loads(self._broadcast.value)

    def release(self) -> None:
        """Frees it everywhere, when all that needs it has been written."""
        self._broadcast.destroy()


def session_broadcast(spark: SparkSession, value: object, size: int, bound: int) -> object:
    """A broadcast variable for a value whose size was measured; beyond the bound it is an error,
    and the caller has to work in blocks."""
    if size > bound:
        raise ValueError(f"{size} bytes are beyond the bound of {bound} for a broadcast")
    if isinstance(value, np.ndarray | str):
        return spark.sparkContext.broadcast(value)
    return Shared(spark.sparkContext.broadcast(cloudpickle.dumps(value)))


def process_state() -> dict:
    """A dictionary that lives as long as this worker process, from task to task."""
    return sys.modules.setdefault("_wavemark_process", types.ModuleType("_wavemark_process")).__dict__


def pickled_size(value: object) -> int:
    return len(cloudpickle.dumps(value))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that few rows are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def rows_per_task(spark: SparkSession, total: int, each: int) -> int:
    """Partitions so that each holds about `each` of `total`, at least the session's parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // max(1, each)), 1)
