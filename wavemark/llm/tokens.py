"""Operator 9: token ids in Arrow stream files of fixed-size-list batches.

Documents are dealt out by ranges of doc_id and sorted, then tokenised and written where they
stand, so file f holds a run of ids and the files in order hold all. The ranges come from the keys
alone, so that texts are read and packed once. Texts travel, not ids, which
are larger, and each in zstd, which takes two thirds of what the shuffle's own compression does. In a file the ids of its documents stand end to end, each document closed by the end
id, cut in sequences of `length` ids; the last is filled up. A row is one sequence: `ids`
(fixed-size list of uint16, or uint32 for vocabularies beyond 65536) and `mask` (fixed-size list of
uint8, 1 for ids and 0 for filling; whole bytes, so that it is read without a copy as well). All batches of a file hold the same number of rows and so the same number
of bytes, which makes a stream as good as an indexed file: batch k starts at first + k * step, so
any sequence is found by arithmetic and read without decoding, from a memory map without a copy.
Which documents stand in a file is in a second stream, of (doc_id, n_tokens), beside it.

Files go to the shared folder by way of the store's own client, first under a name of the attempt
and then renamed; the rows of the writing job name the files of the attempts that counted, so a
task that is lost or run twice leaves at worst a file that nothing names.

Tokenising caches by chunk: the tokeniser never joins text across certain places, such as the start
of a run of non-space characters with the space before it, so what lies between them is encoded
once and its ids copied. Texts with characters that split differently in Python go to the tokeniser
whole, and so do all texts if the file does not name the splitting that the chunks are cut for.

Cases: a null text is an empty one and gives only the end id; an id on several rows has a place for
each, in the order of their texts' hashes; null ids stand first; very long texts cross as many
sequences and batches as they need; an empty table writes no file and gives no rows; other columns
are not read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, process_state, rows_per_task, session_broadcast, slices, written

CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Finer ones for Latin-1, of which both sides agree what a letter or number is: words with what
#: follows an apostrophe, and runs of other signs.
LATIN_CHUNKS = re.compile(r" ?[^\W_]+(?:'[^\W_]+)*|'[^\W_]+(?:'[^\W_]+)*| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
#: How a tokenizers file names the splitting that these patterns follow.
SPLITTING = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Characters that Python counts as white space and the tokeniser does not.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Chunks that a generation of a worker process's cache holds, about 200 bytes each. A full one
#: becomes the old generation, from which chunks that still occur move to the new.
CACHE = 700_000


def chunks_of(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return CHUNKS.findall(text)
    return LATIN_CHUNKS.findall(text)


@dataclass(frozen=True)
class TokenFileConfig:
    """tokenizer: path of a tokenizers file; length: ids in a sequence; rows: sequences in a batch."""

    tokenizer: str
    end_id: int = 0
    length: int = 2048
    rows: int = 16
    docs_per_file: int = 25_000


class ChunkTokenizer:
    """Encodes texts as the tokenizers library does, each distinct chunk once while it is cached."""

    def __init__(self, text: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(text)
        told = json.loads(text)
        splitting = told.get("pre_tokenizer") or {}
        self.cuts = told.get("normalizer") is None and {"use_regex": True, **splitting}.items() >= SPLITTING.items()
        self.whole = (*ODD_SPACE, *(t.content for t in self.own.get_added_tokens_decoder().values()))
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        ids = self.own.encode("\n", add_special_tokens=False).ids
        self.newline = ids[0] if len(ids) == 1 else None

    @classmethod
    def of_process(cls, text: str) -> ChunkTokenizer:
        """The tokeniser of this worker process, which keeps its cache from task to task."""
        held = process_state().setdefault("tokenizers", {})
        key = hash(text)
        if key not in held:
            held.clear()
            held[key] = cls(text)
        return held[key]

    def _unknown(self, chunks: list[list[str] | None]) -> set[str]:
        out: set[str] = set()
        for x in filter(None, chunks):
            out.update(filterfalse(self.cache.__contains__, x))
        return out

    def _learn(self, fresh: list[str]) -> None:
        """Encodes chunks and caches their ids. Chunks of other than white space go in one text with
        line ends between them, which are tokens of their own there, and are told apart by these."""
        words = [] if self.newline is None else [c for c in fresh if not c.isspace()]
        if words:
            ids = np.array(self.own.encode_batch_fast(["\n".join(words) + "\n"], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.newline)
            if len(cuts) == len(words):
                raw, ends = ids.tobytes(), (4 * cuts).tolist()
                self.cache.update(zip(words, (raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends, strict=False)), strict=True))
        rest = [c for c in fresh if c not in self.cache]
        self.cache.update(zip(rest, (array("I", e.ids).tobytes() for e in self.own.encode_batch_fast(rest, add_special_tokens=False)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        chunks = [chunks_of(t) if self.cuts and not any(map(t.__contains__, self.whole)) else None for t in texts]
        fresh = self._unknown(chunks)
        if len(self.cache) + len(fresh) > CACHE:
            self.cache, self.old = {}, self.cache
            fresh = self._unknown(chunks)
        known = fresh & self.old.keys()
        self.cache.update(zip(known, map(self.old.__getitem__, known), strict=True))
        fresh = list(fresh - known)
        for i in range(0, len(fresh), 2_000):
            self._learn(fresh[i : i + 2_000])
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) if x is not None else np.array(self.own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for x, t in zip(chunks, texts, strict=True)]


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The client of the store that holds a path, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def sequence_schema(cfg: TokenFileConfig, vocabulary: int) -> pa.Schema:
    kind = pa.uint16() if max(vocabulary, cfg.end_id + 1) <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(pa.field("id", kind, False), cfg.length)), ("mask", pa.list_(pa.field("token", pa.uint8(), False), cfg.length))])


DOCS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Writes documents to a stream of equal batches of equal sequences."""

    def __init__(self, sink, cfg: TokenFileConfig, schema: pa.Schema) -> None:
        self.size, self.schema = cfg.length * cfg.rows, schema
        self.out = pa.ipc.new_stream(sink, schema)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= 8 * self.size:
            self._flush(self.held // self.size * self.size)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.array([], np.uint16)
        for i in range(0, upto, self.size):
            part = ids[i : i + self.size]
            columns = np.pad(part, (0, self.size - len(part))), (np.arange(self.size) < len(part)).astype(np.uint8)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, f.type.value_type), type=f.type) for x, f in zip(columns, self.schema, strict=True)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.parts, self.held = [ids[upto:]], max(0, len(ids) - upto)

    def close(self) -> None:
        self._flush(self.held)
        self.out.close()


class SequenceFile:
    """Random access to a stream of equal batches: only the schema and one batch's frame are ever
    parsed. `source` is any Arrow random-access file; a memory map gives views without a copy."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0)
        reader = pa.ipc.MessageReader.open_stream(source)
        self.schema = pa.ipc.read_schema(reader.read_next_message())
        self.first = source.tell()
        try:
            message = reader.read_next_message()
            self.step = source.tell() - self.first
            self.rows = pa.ipc.read_record_batch(message, self.schema).num_rows
            self.batches = (source.size() - self.first) // self.step
        except StopIteration:
            self.step = self.rows = self.batches = 0

    def batch(self, k: int) -> pa.RecordBatch:
        self.source.seek(self.first + k * self.step)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch = self.batch(i // self.rows)
        length, at = self.schema.field(0).type.list_size, i % self.rows
        ids, mask = (c.values.slice(at * length, length).to_numpy() for c in batch.columns)
        return ids, mask.view(bool)


KEY = np.dtype([("given", "i1"), ("doc_id", "<i8"), ("text_key", "<i8")])
#: Greatest number of files, each of which has one key in the table of their ends.
MOST_FILES = 1 << 20


def file_ends(docs: DataFrame, files: int) -> np.ndarray:
    """The greatest key of each file, in order, when keys (doc_id, text_key) are ranged evenly: only
    keys move for that. Null ids come first."""
    given = F.col("doc_id").isNotNull().cast("int")
    keys = docs.select(given.alias("given"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("text_key"))
    keys = keys.repartitionByRange(files, "given", "doc_id", "text_key")
    ends = keys.groupBy(F.spark_partition_id()).agg(F.max(F.struct("given", "doc_id", "text_key")).alias("x")).select("x.*").toArrow()
    out = np.zeros(ends.num_rows, KEY)
    for c in KEY.names:
        out[c] = ends.column(c).to_numpy()
    return np.sort(out)


def deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, size, data): texts in zstd and their sizes in bytes; null is empty."""
    codec = pa.Codec("zstd", 1)
    for batch in slices(batches):
        texts = [x or b"" for x in batch.column(2).to_pylist()]
        data = [codec.compress(x, asbytes=True) if x else b"" for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, texts), pa.int32()), pa.array(data, pa.binary())], ["doc_id", "text_key", "size", "data"])


def dealt(batches: Iterator[pa.RecordBatch], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of `deflated` with the file that each goes to, as part."""
    for batch in deflated(batches):
        key = np.zeros(batch.num_rows, KEY)
        key["given"], key["doc_id"], key["text_key"] = batch.column(0).is_valid().to_numpy(False), batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
        part = np.minimum(np.searchsorted(ends, key), max(0, len(ends) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], ["part", *batch.schema.names])


def inflated(sizes: pa.Array, data: pa.Array) -> list[str]:
    codec = pa.Codec("zstd")
    return [codec.decompress(x, n, asbytes=True).decode() if n else "" for n, x in zip(sizes.to_pylist(), data.to_pylist(), strict=True)]


def write_files(docs: DataFrame, cfg: TokenFileConfig, out: str) -> DataFrame:
    """Writes the files under `out`; one row a file: (part, path, docs_path, n_docs, n_tokens)."""
    with open(cfg.tokenizer, encoding="utf-8") as f:
        text = f.read()
    shared = session_broadcast(docs.sparkSession, text, len(text), 64 << 20)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, end = ChunkTokenizer.of_process(shared.value), np.array([cfg.end_id], "<u4").tobytes()
        schema = sequence_schema(cfg, tokenizer.own.get_vocab_size())
        kind = schema.field("ids").type.value_type.to_pandas_dtype()
        fs, root = store(out)
        fs.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{root}/part-{part:06d}-{attempt}.{x}.arrows" for x in ("tokens", "docs")]
        n_docs = n_tokens = 0
        gc.disable()  # nothing here has cycles, and the cache would be walked again and again
        try:
            with fs.open_output_stream(f"{names[0]}.tmp") as tokens, fs.open_output_stream(f"{names[1]}.tmp") as index:
                sequences, places = SequenceWriter(tokens, cfg, schema), pa.ipc.new_stream(index, DOCS)
                for batch in batches:
                    for i in range(0, batch.num_rows, 500):
                        some = batch.slice(i, 500)
                        ids = [np.frombuffer(x + end, "<u4") for x in tokenizer.encode(inflated(some.column(1), some.column(2)))]
                        for x in ids:
                            sequences.add(x.astype(kind))
                        lengths = [len(x) for x in ids]
                        places.write_batch(pa.RecordBatch.from_arrays([some.column(0), pa.array(lengths, pa.int64())], schema=DOCS))
                        n_docs, n_tokens = n_docs + len(lengths), n_tokens + sum(lengths)
                sequences.close()
                places.close()
        finally:
            gc.enable()
        for name in names:
            if n_docs:
                fs.move(f"{name}.tmp", name)
            else:
                fs.delete_file(f"{name}.tmp")
        if n_docs:
            row = ((part, pa.int32()), (names[0], pa.string()), (names[1], pa.string()), (n_docs, pa.int64()), (n_tokens, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], ["part", "path", "docs_path", "n_docs", "n_tokens"])

    total = docs.count()
    files = rows_per_task(docs.sparkSession, total, max(cfg.docs_per_file, -(-total // MOST_FILES)))
    ends = file_ends(docs, files)
    bounds = session_broadcast(docs.sparkSession, ends, ends.nbytes, MOST_FILES * KEY.itemsize)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(lambda batches: dealt(batches, bounds.value), "part int, doc_id long, text_key long, size int, data binary")
    rows = rows.repartitionById(max(1, len(ends)), "part").sortWithinPartitions("doc_id", "text_key").select("doc_id", "size", "data")
    return written(rows.mapInArrow(write, "part int, path string, docs_path string, n_docs long, n_tokens long"), "token-files")


def read_files(spark: SparkSession, files: DataFrame, out: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32, file."""
    order = Window.partitionBy().orderBy("part")
    files = files.withColumn("first", F.sum("n_tokens").over(order) - F.col("n_tokens"))
    tasks = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(out)
        for batch in batches:
            for part, path, docs_path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(docs_path) as f, pa.ipc.open_stream(f) as places:
                    known = places.read_all()
                doc_ids, told = known.column("doc_id"), known.column("n_tokens").to_numpy()
                sums, crc, left = [], 0, int(told[0])
                with fs.open_input_file(path) as f:
                    sequences = SequenceFile(f)
                    for k in range(sequences.batches):
                        ids, mask = (c.values.to_numpy() for c in sequences.batch(k).columns)
                        ids, a = ids[mask.view(bool)].astype("<u4"), 0
                        while a < len(ids):
                            b = min(len(ids), a + left)
                            crc, left, a = zlib.crc32(ids[a:b].tobytes(), crc), left - (b - a), b
                            if not left:
                                sums.append(crc)
                                crc, left = 0, int(told[len(sums)]) if len(sums) < len(told) else 1 << 62
                if len(sums) != len(told) or crc:
                    raise ValueError(f"{path} does not hold the documents of {docs_path}")
                lengths = told
                starts = first + np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays([doc_ids.combine_chunks(), pa.array(starts), pa.array(lengths), pa.array(sums, pa.int64()), pa.array([part] * len(lengths), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    rows = files.select("part", "path", "docs_path", "first").repartition(tasks, "part")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file int")


def round_trip(docs: DataFrame, cfg: TokenFileConfig) -> DataFrame:
    """Writes all documents to files in the shared folder and reads them back."""
    spark = docs.sparkSession
    out = fresh_path(spark, "tokens")
    return read_files(spark, write_files(docs, cfg, out), out)
