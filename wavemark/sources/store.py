"""An index on disk: parts of Parquet tables under one folder, and numbered pointers that name them.

A part holds tracks, postings and, if it came from files, a list of these. It is written whole under a
new name, and then a pointer with the next number is put in place, which fails if another writer has
taken that number: the loser reads the new state and tries again, so ids of tracks stay dense whoever
comes first. The highest pointer counts. At any moment readers see the old or the new index, a writer
that dies leaves the old one, and saving an index to where it was read from does not double it.

Postings lie in folders by `shard`, the low bits of a hash of the fingerprint, and sorted by
fingerprint inside; a part has so many shards that each holds about `shard_rows`. A query's shards are
known from its fingerprints, so folders without any of them are not opened: the query's side of the
join is broadcast and prunes the partitions of the other (dynamic partition pruning). Beyond
`PRUNING` different fingerprints a batch touches every shard anyway and is joined without that.

Parts are levelled by size. Appending adds a part; when a level holds `fanout` parts they are merged
into one, so there are at most `fanout - 1` of each of a logarithmic number of levels, and a posting is
rewritten once a level. Merging is a commit like any other; one whose inputs are gone is dropped.

On a local disk the pointer is put in place by a link, elsewhere by a rename; the file system has to
refuse a rename onto a file that is there, as HDFS does.

The tables of the last two states stay for readers that still use them, and those that merges have
replaced in between; parts that no pointer ever named are dropped when they are a day old.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import IndexConfig
from ..errors import IndexStoreError, StoreIoError
from ..operators.index import FingerprintIndex, numbered
from ..shared import forget, hadoop_path, written

POINTER, FORMAT = "CURRENT-", 2
#: Different fingerprints of a batch up to which shards are pruned: 12 bytes of each are broadcast.
PRUNING = 200_000
#: Seconds before a part that no pointer names counts as left behind, and attempts to commit.
GRACE, ATTEMPTS = 86_400, 100
#: Names of segments that a pointer remembers; they are deleted long before so many have come.
SEGMENTS = 1_000
FILES = "path string, length bigint, modified timestamp, checksum string, track_name string, error string, seen bigint"


@dataclass(frozen=True)
class Layout:
    """Sizes of shards and levels, in postings."""

    shard_rows: int = 500_000
    max_shards: int = 4_096
    level_rows: int = 250_000
    fanout: int = 4

    def shards(self, postings: int) -> int:
        """A power of two."""
        return min(self.max_shards, 1 << max(0, math.ceil(postings / self.shard_rows) - 1).bit_length())

    def level(self, postings: int) -> int:
        level, rows = 0, self.level_rows
        while postings >= rows:
            level, rows = level + 1, rows * self.fanout
        return level


def shard_of(fingerprint: Column, shards: int) -> Column:
    return F.xxhash64(fingerprint).bitwiseAND(shards - 1).cast("int")


class SegmentTaken(IndexStoreError):
    """Another writer has taken this segment in."""


def with_segments(meta: dict, before: dict, fresh: list[str]) -> dict:
    """What a pointer says after `before`, with the names of written segments (`sink`) whose rows the
    index holds."""
    taken = before.get("segments", [])
    if set(fresh) & set(taken):
        raise SegmentTaken(", ".join(fresh))
    return meta | {"segments": [*taken, *fresh][-SEGMENTS:]}


class Store:
    """The folder of an index, reached through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._io = self._jvm.org.apache.commons.io.IOUtils
        _, self._fs = hadoop_path(spark, self.path)

    def children(self) -> list[str]:
        at = self._path(self.path)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        """Numbers of the pointers, in order."""
        return sorted(int(x.removeprefix(POINTER)) for x in self.children() if x.startswith(POINTER) and x.removeprefix(POINTER).isdigit())

    def exists(self) -> bool:
        return bool(self.numbers())

    def _pointer(self, number: int):
        return self._path(f"{self.path}/{POINTER}{number:012d}")

    def current(self, number: int | None = None) -> dict:
        if number is None:
            numbers = self.numbers()
            if not numbers:
                raise StoreIoError(f"{self.path}: no index there")
            number = numbers[-1]
        try:
            stream = self._fs.open(self._pointer(number))
        except Py4JJavaError as e:
            raise StoreIoError(f"{self.path}: {e.java_exception}") from e
        try:
            meta = json.loads(self._io.toString(stream, "UTF-8"))
        except ValueError as e:
            raise IndexStoreError(f"{self.path}: {e}") from e
        finally:
            stream.close()
        if meta.get("format") != FORMAT:
            raise IndexStoreError(f"{self.path}: not an index of this version")
        return meta

    def latest(self) -> tuple[int, dict]:
        """The last pointer's number and what it says; 0 and an index without parts if there is none."""
        for _ in range(ATTEMPTS):
            numbers = self.numbers()
            if not numbers:
                return 0, self.described([], IndexConfig())
            try:
                return numbers[-1], self.current(numbers[-1])
            except StoreIoError:
                if self.numbers()[-1:] == numbers[-1:]:
                    raise
        raise StoreIoError(f"{self.path}: other writers are faster")

    @staticmethod
    def described(parts: list[dict], config: IndexConfig) -> dict:
        return {"format": FORMAT, "kind": "data", "parts": parts, "offset_bin_size": config.offset_bin_size}

    def commit(self, number: int, meta: dict) -> bool:
        """Puts the pointer of this number in place, unless another writer has done so."""
        fresh, target = self._path(f"{self.path}/.pointer-{uuid.uuid4().hex}"), self._pointer(number)
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                # A rename on a local disk replaces what is there; a link does not.
                paths = [self._jvm.java.io.File(x.toUri().getPath()).toPath() for x in (target, fresh)]
                self._jvm.java.nio.file.Files.createLink(*paths)
                return True
            return not self._fs.exists(target) and self._fs.rename(fresh, target)
        except Py4JJavaError as e:
            if self._fs.exists(target):
                return False
            raise StoreIoError(f"{self.path}: {e.java_exception}") from e
        finally:
            self._fs.delete(fresh, False)

    def point(self, meta: dict) -> None:
        """Makes this the state of the index, whatever it was before, then clears."""
        for _ in range(ATTEMPTS):
            number, before = self.latest()
            if self.commit(number + 1, with_segments(meta, before, meta.get("segments", []))):
                return self.clear()
        raise StoreIoError(f"{self.path}: other writers are faster")

    def clear(self) -> None:
        """Drops pointers before the last two states, parts that only those name, and what writers that
        died have left."""
        known = {}
        for n in self.numbers():
            try:
                known[n] = self.current(n)
            except StoreIoError:
                continue  # another writer clears at this moment
        states = [n for n, meta in known.items() if meta["kind"] == "data"]
        first = states[-2] if len(states) > 1 else min(known, default=0)
        held = {part["name"] for n, meta in known.items() if n >= first for part in meta["parts"]}
        named = {part["name"] for meta in known.values() for part in meta["parts"]}
        for name in sorted(named - held):
            self.drop(name)
        for n in known:
            if n < first:
                self._fs.delete(self._pointer(n), False)
        old = 1000 * (time.time() - GRACE)
        for x in self._fs.listStatus(self._path(self.path)):
            name = x.getPath().getName()
            if name.startswith((".pointer-", "snapshot-", "part-")) and name not in named and x.getModificationTime() < old:
                self.drop(name)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def table(self, parts: list[dict], name: str) -> DataFrame:
        """Tracks or files of these parts."""
        kind = {"tracks": schemas.TRACKS, "files": FILES}[name]
        paths = [f"{self.path}/{part['name']}/{name}" for part in parts if name in part]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def postings(self, parts: list[dict]) -> list[DataFrame]:
        """(hash, track_id, anchor_time, shard) of each part: a scan for each, as shards are its own."""
        return [self.spark.read.schema(f"{schemas.POSTINGS}, shard int").parquet(f"{self.path}/{part['name']}/postings") for part in parts]

    def write(self, name: str, tracks: DataFrame, postings: DataFrame, files: DataFrame | None, layout: Layout) -> dict:
        """Writes a part and describes it."""
        at, rows = f"{self.path}/{name}", written(postings.select("hash", "track_id", "anchor_time"), "store-postings")
        n = rows.count()
        shards = layout.shards(n)
        key = ["shard", "hash", "track_id", "anchor_time"]
        # Ranges of the whole row, so that a very common fingerprint fills several files.
        sharded = rows.withColumn("shard", shard_of(F.col("hash"), shards)).repartitionByRange(max(shards, -(-n // layout.shard_rows)), *key)
        sharded.sortWithinPartitions(*key).write.partitionBy("shard").parquet(f"{at}/postings")
        tracks.select("track_id", "track_name").write.parquet(f"{at}/tracks")
        part = {"name": name, "shards": shards, "postings": n, "tracks": self.spark.read.schema(schemas.TRACKS).parquet(f"{at}/tracks").count()}
        if files is not None:
            files.write.parquet(f"{at}/files")
            part["files"] = True
        forget(rows)
        return part


def _union(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], schemas.POSTINGS)


def _named_by(store: Store, name: str) -> bool:
    return store.exists() and any(part["name"] == name for part in store.latest()[1]["parts"])


def save(index: FingerprintIndex, path: str, layout: Layout | None = None, segment: str | None = None) -> None:
    """Makes the folder hold exactly this index; saving again changes nothing."""
    store, name = Store(index.tracks.sparkSession, path), f"snapshot-{uuid.uuid4().hex}"
    try:
        part = store.write(name, index.tracks, index.postings, None, layout or Layout())
        store.point(store.described([part], index.config) | {"segments": [segment] if segment else []})
    except BaseException as e:
        if not _named_by(store, name):
            store.drop(name)
        if isinstance(e, Exception) and not isinstance(e, StoreIoError):
            raise StoreIoError(f"{path}: {e}") from e
        raise


def append(spark: SparkSession, path: str, fingerprints: DataFrame, names: DataFrame | None = None, files: DataFrame | None = None, layout: Layout | None = None, segment: str | None = None, merge: bool = True) -> None:
    """Adds tracks and postings as one more part beside those on disk, then merges levels that are full,
    unless that is left to another job (`compact`). Only the new rows are written. Writers may come at the same time: known names keep their ids and new
    ones take the next, counted again if another writer was first."""
    store, layout = Store(spark, path), layout or Layout()
    prints = written(fingerprints.select("track_name", "hash", "anchor_time"), "store-prints")
    incoming = written((prints.select("track_name") if names is None else prints.select("track_name").unionByName(names.select("track_name"))).distinct(), "store-names")
    listed = None if files is None else written(files, "store-files")
    for _ in range(ATTEMPTS):
        number, meta = store.latest()
        name = f"part-{uuid.uuid4().hex}"
        try:
            held = store.table(meta["parts"], "tracks")
            fresh = written(numbered(incoming.join(held, "track_name", "left_anti"), sum(part["tracks"] for part in meta["parts"])), "store-tracks")
            ids = fresh.unionByName(held.join(incoming, "track_name", "left_semi").select("track_id", "track_name"))
            part = store.write(name, fresh, FingerprintIndex._postings(prints, ids), None if listed is None else listed.withColumn("seen", F.lit(number + 1).cast("long")), layout)
            done = store.commit(number + 1, with_segments(meta | {"kind": "data", "parts": [*meta["parts"], part]}, meta, [segment] if segment else []))
        except BaseException as e:
            store.drop(name)
            if store.latest()[0] == number or isinstance(e, SegmentTaken):
                raise
            continue  # what this attempt read was cleared by writers that came first
        if done:
            forget(prints, incoming, fresh, *([listed] if listed is not None else []))
            store.clear()
            if merge:
                compact(spark, path, layout)
            return
        store.drop(name)
        forget(fresh)
    raise StoreIoError(f"{path}: other writers are faster")


def compact(spark: SparkSession, path: str, layout: Layout | None = None) -> int:
    """Merges the parts of full levels, lowest first, and says how many merges it made."""
    store, layout, merges = Store(spark, path), layout or Layout(), 0
    while True:
        levels = defaultdict(list)
        for part in store.latest()[1]["parts"]:
            levels[layout.level(part["postings"])].append(part)
        full = sorted(level for level, parts in levels.items() if len(parts) >= layout.fanout)
        if not full:
            return merges
        merged, name = levels[full[0]], f"part-{uuid.uuid4().hex}"
        files = store.table(merged, "files") if any("files" in part for part in merged) else None
        gone = {part["name"] for part in merged}
        try:
            part = store.write(name, store.table(merged, "tracks"), _union(spark, store.postings(merged)), files, layout)
        except Exception:
            store.drop(name)
            if gone <= {x["name"] for x in store.latest()[1]["parts"]}:
                raise
            continue
        for _ in range(ATTEMPTS):
            number, meta = store.latest()
            if not gone <= {x["name"] for x in meta["parts"]}:
                store.drop(name)
                break
            if store.commit(number + 1, meta | {"kind": "merge", "parts": [*(x for x in meta["parts"] if x["name"] not in gone), part]}):
                merges += 1
                store.clear()
                break


def load(spark: SparkSession, path: str) -> FingerprintIndex:
    """Fails if there is no index."""
    store = Store(spark, path)
    meta = store.current()
    return FingerprintIndex(store.table(meta["parts"], "tracks"), _union(spark, store.postings(meta["parts"])).drop("shard"), IndexConfig(meta["offset_bin_size"]))


def open_or_create(spark: SparkSession, path: str, config: IndexConfig | None = None) -> FingerprintIndex:
    if not Store(spark, path).exists():
        save(FingerprintIndex.empty(spark, config), path)
    return load(spark, path)


def known_files(spark: SparkSession, path: str) -> DataFrame:
    """What the index was made from: of each path, what was seen of it last."""
    store = Store(spark, path)
    rows = store.table(store.latest()[1]["parts"], "files")
    return rows.groupBy("path").agg(F.max_by(F.struct("length", "modified", "checksum", "track_name", "error"), "seen").alias("x")).select("path", "x.*")


def hit_postings(spark: SparkSession, path: str, hashes: DataFrame) -> FingerprintIndex:
    """The index with the postings whose fingerprint is among (hash), read from their shards alone."""
    store = Store(spark, path)
    meta = store.current()
    asked = written(hashes.select("hash").distinct(), "store-asked")
    if asked.count() > PRUNING:
        return load(spark, path)
    found = []
    for part, rows in zip(meta["parts"], store.postings(meta["parts"]), strict=True):
        # The comparison holds for every row; pruning is planned only where the small side is filtered.
        near = asked.select("hash", shard_of(F.col("hash"), part["shards"]).alias("shard")).filter(F.col("shard") >= 0)
        found.append(rows.join(F.broadcast(near), ["shard", "hash"], "left_semi").drop("shard"))
    return FingerprintIndex(store.table(meta["parts"], "tracks"), _union(spark, found), IndexConfig(meta["offset_bin_size"]))


def query_store(spark: SparkSession, path: str, queries: DataFrame, top_k: int = 1, min_score: int = 1) -> DataFrame:
    """Queries an index on disk, opening only the shards of the queries' fingerprints."""
    return hit_postings(spark, path, queries).query_batch(queries, top_k, min_score)
