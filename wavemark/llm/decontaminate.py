"""Operator 1: benchmark decontamination by a BM25 index of the test items with block-max WAND.

The items are the indexed side and every passage of every training document is a query. A posting
list is kept for each term, ordered by item, with weights divided by the item's own total, so one
threshold fits all items: 1 is an item whose every term stands in the passage. Items are cut in
runs, the blocks, and each list knows its largest weight in each block. For a passage the largest
weights of its terms are added block by block, and only a block whose sum reaches the threshold is
opened. In it the lists are walked by pivots: an item is scored only if the lists that may hold it
can together reach the threshold. All items above the threshold are retrieved, not the best few.

A retrieved item is then verified on the words of the document around the passage: the shares of
the question's and of the answer's word n-grams that occur there must both be reached. An item's
answer is its own column if there is one, else its last sentence, and the rest is the question; an
item of one sentence is all question, and needs no answer.

Passages overlap by half and are twice as long as the longest item, so each occurrence of an item
lies whole in one. Document frequencies, mean length and the passages' length are of all items.
Items are indexed in parts of bounded size: a part whose pickled index is beyond `index_bytes` is
halved. All parts are searched in one pass over the documents, as long as together they stay within
`broadcast_bytes`; beyond it there is one pass for each so many. A task holds one part at a time, and
`held_chars` of documents or one document.

Cases: null or empty texts and items hold nothing; a very long text is many passages; an item of
fewer words than an n-gram is compared as one n-gram of its length; equal items are each reported;
of passages that tie, one counts; repeated rows each count, and a document is reported once for each
item; a row without doc_id can be filtered but not named in the report; tables may be empty; other
columns pass through the filter untouched, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_row, window_hashes, word_hashes, written

TERM = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class DecontaminationConfig:
    """threshold: least normalised BM25 score; question, answer: least shares of n-grams found."""

    threshold: float = 0.6
    question: float = 0.6
    answer: float = 0.5
    ngram: int = 5
    k1: float = 1.2
    b: float = 0.75
    block: int = 8
    index_chars: int = 4 << 20
    index_bytes: int = 48 << 20
    broadcast_bytes: int = 512 << 20
    held_chars: int = 16 << 20


def terms(text: str | None) -> list[str]:
    return TERM.findall(text.lower()) if text else []


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of an item that has no answer of its own."""
    parts = SENTENCE_END.split(text.strip()) if text else []
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else ((parts or [""])[0], "")


def ngrams(words: list[str], n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of terms, or of all of them if they are fewer."""
    return np.unique(window_hashes(word_hashes([w.encode() for w in words]), n))


@dataclass(frozen=True)
class Totals:
    """What is known of all items: their number, mean and greatest length in terms."""

    items: int
    mean: float
    longest: int

    @property
    def span(self) -> int:
        return 2 * self.longest or 2


def totals_of(items: list[tuple[int, str, str]]) -> tuple[Totals, Counter]:
    """Totals and document frequencies of a list of items."""
    found = [terms(q) + terms(a) for _, q, a in items]
    lengths = [len(x) for x in found]
    return Totals(len(items), sum(lengths) / max(1, len(lengths)) or 1.0, max(lengths, default=0)), Counter(t for x in found for t in set(x))


class Index:
    """Inverted index of items, in blocks, as arrays: of each term its items in order, with their
    weights, and the blocks it occurs in, with its largest weight there."""

    def __init__(self, items: list[tuple[int, str, str]], cfg: DecontaminationConfig, totals: Totals | None = None, df: dict[str, int] | None = None) -> None:
        if totals is None:
            totals, df = totals_of(items)
        self.cfg, self.span = cfg, totals.span
        self.ids = [i for i, _, _ in items]
        parts = [(terms(q), terms(a)) for _, q, a in items]
        self.sizes = np.array([[min(cfg.ngram, len(q)), min(cfg.ngram, len(a))] for q, a in parts], np.int16).reshape(-1, 2)
        grams = [ngrams(x, cfg.ngram) for pair in parts for x in pair]
        self.cuts = np.concatenate([[0], np.cumsum([len(x) for x in grams])]).astype(np.int64)
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.terms: dict[str, int] = {}
        at, item_of, weight = [], [], []
        for item, (q, a) in enumerate(parts):
            count = Counter(q + a)
            norm = cfg.k1 * (1 - cfg.b + cfg.b * (len(q) + len(a)) / totals.mean)
            weights = {t: math.log(1 + (totals.items - df[t] + 0.5) / (df[t] + 0.5)) * n * (cfg.k1 + 1) / (n + norm) for t, n in count.items()}
            total = sum(weights.values())
            for t, w in weights.items():
                at.append(self.terms.setdefault(t, len(self.terms)))
                item_of.append(item)
                weight.append(w / total)
        at, item_of, weight = np.array(at, np.int64), np.array(item_of, np.int32), np.array(weight)
        order = np.argsort(at, kind="stable")
        at, self.items, self.weights = at[order], item_of[order], weight[order]
        self.starts = np.searchsorted(at, np.arange(len(self.terms) + 1))
        block = self.items // cfg.block
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        self.blocks = -(-len(items) // cfg.block)
        self.ceiling_blocks = block[first]
        self.ceilings = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.ceiling_starts = np.searchsorted(at[first], np.arange(len(self.terms) + 1))
        #: Of each term its blocks and ceilings, made where the index is used and not pickled before.
        self.views: list[tuple[np.ndarray, np.ndarray]] | None = None

    def above(self, passage: set[str]) -> list[tuple[int, float]]:
        """Items whose score for the passage reaches the threshold, by block-max WAND."""
        if not passage:
            return []
        if self.views is None:
            cuts = self.ceiling_starts[1:-1]
            self.views = list(zip(np.split(self.ceiling_blocks, cuts), np.split(self.ceilings, cuts), strict=True))
        # In a fixed order, so that equal passages score equally to the last bit.
        numbers = sorted(map(self.terms.__getitem__, passage))
        at, most = zip(*map(self.views.__getitem__, numbers), strict=True)
        bounds = np.bincount(np.concatenate(at), np.concatenate(most), self.blocks)
        return [x for block in np.flatnonzero(bounds >= self.cfg.threshold - 1e-9) for x in self._open(numbers, int(block))]

    def _open(self, numbers: list[int], block: int) -> list[tuple[int, float]]:
        """Walks the lists inside one block by pivots."""
        least, out = self.cfg.threshold - 1e-9, []
        start, stop = block * self.cfg.block, (block + 1) * self.cfg.block
        cursors = []
        for t in numbers:
            a, b = self.starts[t], self.starts[t + 1]
            own = self.items[a:b]
            lo, hi = a + own.searchsorted(start), a + own.searchsorted(stop)
            if lo < hi:
                items, weights = self.items[lo:hi].tolist(), self.weights[lo:hi].tolist()
                cursors.append([items[0], 0, len(items), max(weights), items, weights])
        while cursors:
            cursors.sort(key=itemgetter(0))
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= least:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            score = 0.0
            for c in cursors:
                if c[0] > pivot:
                    break
                k = bisect_left(c[4], pivot, c[1], c[2])
                if k < c[2] and c[4][k] == pivot:
                    score += c[5][k]
                    k += 1
                c[0], c[1] = (c[4][k] if k < c[2] else stop), k
            if score >= least:
                out.append((pivot, score))
            cursors = [c for c in cursors if c[0] < stop]
        return out

    def matches(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """Verified items of a whole text: score, question and answer share, each of the best
        passage."""
        found: dict[int, tuple[float, float, float]] = {}
        if not text or not self.ids:
            return found
        words, known = terms(text), self.terms.keys()
        step = self.span // 2
        halves = [known & set(words[a : a + step]) for a in range(0, len(words), step)]
        for k in range(max(min(1, len(halves)), len(halves) - 1)):
            passage = halves[k] | halves[k + 1] if k + 1 < len(halves) else halves[k]
            near: dict[int, np.ndarray] = {}
            hashes = None
            for item, score in self.above(passage):
                if hashes is None:
                    hashes = word_hashes([w.encode() for w in words[k * step : k * step + self.span]])
                share = []
                for side in (0, 1):
                    n = int(self.sizes[item, side])
                    own = self.grams[self.cuts[2 * item + side] : self.cuts[2 * item + side + 1]]
                    if n and n not in near:
                        near[n] = window_hashes(hashes, n) if len(hashes) >= n else hashes[:0]
                    share.append(float(np.isin(own, near[n]).mean()) if n else 1.0)
                if self.sizes[item].any() and share[0] >= self.cfg.question and share[1] >= self.cfg.answer:
                    found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score, *share))
        return found


def indexed(items: list[tuple[int, str, str]], cfg: DecontaminationConfig, totals: Totals, df: dict[str, int]) -> Iterator[bytes]:
    """Pickled indexes of the items, each within index_bytes or of one item."""
    index = cloudpickle.dumps(Index(items, cfg, totals, df))
    if len(index) <= cfg.index_bytes or len(items) == 1:
        yield index
    else:
        half = len(items) // 2
        yield from indexed(items[:half], cfg, totals, df)
        yield from indexed(items[half:], cfg, totals, df)


def item_parts(benchmark: DataFrame, cfg: DecontaminationConfig) -> Iterator[bytes]:
    """Pickled indexes of all items, in the order of item_id. The driver holds one part's items, of
    index_chars or one item, and their terms' frequencies at a time."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [split_item(t) if a is None else (t or "", a) for t, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            found = [terms(q) + terms(a) for q, a in sides]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([q for q, _ in sides], pa.string()), pa.array([a for _, a in sides], pa.string()), pa.array([list(set(x)) for x in found], pa.list_(pa.string())), pa.array(list(map(len, found)), pa.int64())], ["item_id", "q", "a", "terms", "length"])

    items = written(rows.mapInArrow(cut, "item_id long, q string, a string, terms array<string>, length long"), "bm25-items")
    n, mean, longest, chars = items.agg(F.count("*"), F.avg("length"), F.max("length"), F.sum(F.length("q") + F.length("a"))).first()
    if not n:
        return
    totals = Totals(n, mean or 1.0, longest)
    parts = max(1, -(-chars // cfg.index_chars))
    # Dealt by ranges of the id and sorted: near equal parts, however many items.
    ranged = written(items.repartitionByRange(parts, "item_id", "q", "a").withColumn("part", F.spark_partition_id()), "bm25-parts")
    flat = ranged.select("part", F.explode("terms").alias("term"))
    df = written(flat.groupBy("term").agg(F.count("*").alias("df")), "bm25-df")
    for part in range(parts):
        own = ranged.filter(F.col("part") == part)
        held = [(r["item_id"], r["q"], r["a"]) for r in own.select("item_id", "q", "a").orderBy("item_id", "q", "a").toLocalIterator()]
        if held:
            found = df.join(flat.filter(F.col("part") == part).select("term").distinct(), "term", "left_semi").toArrow() if parts > 1 else df.toArrow()
            yield from indexed(held, cfg, totals, dict(zip(found.column("term").to_pylist(), found.column("df").to_pylist(), strict=True)))


def passes(benchmark: DataFrame, cfg: DecontaminationConfig) -> Iterator[list]:
    """Broadcast parts, in groups that together are within broadcast_bytes."""
    spark = benchmark.sparkSession
    group, size = [], 0
    for part in item_parts(benchmark, cfg):
        if group and size + len(part) > cfg.broadcast_bytes:
            yield group
            group, size = [], 0
        group.append(spark.sparkContext.broadcast(part))
        size += len(part)
    if group:
        yield group


def unpacked(part) -> Index:
    """The index of one of several broadcast parts. A worker process keeps the bytes of each broadcast
    that it has opened; these are let go, and read again from the executor's disk when they are needed."""
    index = pickle.loads(part.value)
    if getattr(part, "_path", None):
        part.__dict__.pop("_value", None)
    return index


def portions(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """The rows in portions of so many characters of their first column, or of one row."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy()
        a = 0
        while a < batch.num_rows:
            b = a + max(1, int(np.searchsorted(np.cumsum(lengths[a:]), chars - size, "right")))
            held.append(batch.slice(a, b - a))
            size += int(lengths[a:b].sum())
            a = b
            if size >= chars:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig | None = None) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row for each document and
    item verified in it."""
    cfg = cfg or DecontaminationConfig()
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for group in passes(benchmark, cfg):

        def search(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            single = pickle.loads(group[0].value) if len(group) == 1 else None
            for batch in batches if single else portions(batches, cfg.held_chars):
                ids, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
                for part in group:
                    index = None  # before the next one is made
                    index = single or unpacked(part)
                    rows = [(doc, index.ids[item], *best) for doc, text in zip(ids, texts, strict=True) for item, best in index.matches(text).items()]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(docs.filter("doc_id is not null").select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(search, schema))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")).select("doc_id", "item_id", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig | None = None) -> DataFrame:
    """The documents, with their columns, in which no item is verified."""
    cfg = cfg or DecontaminationConfig()
    rows = docs.select("text", whole_row(docs))
    schema = rows.schema
    for group in passes(benchmark, cfg):

        def clean(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            single = pickle.loads(group[0].value) if len(group) == 1 else None
            for batch in batches if single else portions(batches, cfg.held_chars):
                for part in group:
                    index = None  # before the next one is made
                    index = single or unpacked(part)
                    batch = batch.filter(pa.array([not index.matches(text) for text in batch.column(0).to_pylist()], pa.bool_()))
                yield batch

        rows = rows.mapInArrow(clean, schema)
    return rows.select("row.*")
