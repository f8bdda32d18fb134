"""Operator 10: exact n-gram Jaccard join with set-relation skipping.

A document is the set of its word shingles. Documents with the same set form a class, and only one
of a class is compared. Shingles are put in one order for all sets, those known to be frequent
last, and two sets that link must share one of the first ``n - ceil(t*n) + 1`` shingles (the
prefix), so prefixes form an inverted index whose lists hold (document, set size, position).

* Index-level skipping: a list is kept in blocks of equal set size, ordered by position. For a
  probing set, size alone rules out blocks, and within a block only a window of positions can reach
  the needed overlap, so the rest of the block is skipped on both sides.
* Sets that link share not one but many prefix shingles, since each has few that the other lacks.
  Each entry knows how many lists of its set come before and after it, so an entry with too few on
  either side is skipped; pairs are then counted over the lists, and those that share fewer drop.
* Answer-level skipping: every set is first compared with one hub, the set it shares most lists
  with, and keeps its answer as its difference from the hub. Sets of one hub, its family, are then
  never compared again: what two of them share is what their hub holds less what each lacks, plus
  what their differences share, so their answers are derived from the hub's and small differences,
  all of a family at once in memory. A family beyond a block is cut in cells, each solved so, and the
  best linked set of each cell meets those of the others in turn. The best of all becomes the
  family's hub, and only sets that are not in its component then meet the others, in blocks: a family
  costs its size, and its size times the share of a block that its strays fill. Between families, sets already in one component need no
  comparison, and the overlap of two sets is at most that of their hubs plus what each has beyond
  its hub, so once the hubs' answer is known most of the followers' answers follow from it.
* Crowds: where a list leaves more than `crowd` open pairs a set, as when a hub is unlike in size to
  most that share its lists, no pairs are listed. The sets of these pairs meet as one more family of
  the list's first set among them, by differences in memory, so each list costs rows by its length.

All pairs that remain are compared in full: no list, partner or candidate is capped. Lists of
shingles that the sketch shows to be very frequent are split in cells, so no task has to hold one.

Cases: a null or empty text, or one without words, has the empty set and links with nothing; fewer
words than a shingle make one shingle; a very long text is a large set like any other; a row without
doc_id links with nothing and has no component; copies and repeated rows share a class; each row of
a repeated doc_id is grouped by its own text, a set being known by a number of its own and not by
the id; ties between hubs go to the smaller number, which changes no result; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, forget, mix64, session_broadcast, slices, whole_row, window_hashes, word_hashes, written
from .graph import components, may_hold, membership, slot_of

#: Counters of the frequency sketch, as a power of 2: its table takes 16 MB for any input.
SKETCH_BITS = 22
ENTRY = np.dtype([("token", "<u8"), ("id", "<i8"), ("n", "<i4"), ("p", "<i4")])


@dataclass(frozen=True)
class JaccardConfig:
    """Two sets link when scale * intersection >= least * union. A list that the sketch
    says may hold more than `hot` sets is split; shard_bytes is the aim for one task's share of the
    index; family_block, family_bytes: sets compared at once, and the size of their differences;
    hub_rows: sets that meet one copy of their hub; crowd: open pairs a set of a list beyond which its
    sets meet as a family."""

    width: int = 5
    least: int = 80
    scale: int = 100
    hot: int = 20_000
    shard_bytes: int = 16 << 20
    family_block: int = 2_000
    family_bytes: int = 32 << 20
    hub_rows: int = 256
    crowd: int = 4

    def prefix(self, n: int) -> int:
        return n - -(-self.least * n // self.scale) + 1 if n else 0

    def shared(self, n: str, m: str) -> str:
        """SQL for the least number of prefix shingles that linking sets of n and m share: either
        prefix, whichever ends first in the order, holds at most its set's surplus beside them."""
        both = f"ceil({self.least} * ({n} + {m}) / {self.scale + self.least}D - 1e-9)"
        return f"{both} - ceil({self.least} * greatest({n}, {m}) / {self.scale}D - 1e-9) + 1"

    def shared_of(self, n, m):
        """The same for arrays."""
        return self.overlap(n, m) - -(-self.least * np.maximum(n, m) // self.scale) + 1

    def reach(self, n: str, p: str, m: str, q: str) -> str:
        """SQL: sets of n and m with a common shingle at p and q can reach the needed overlap."""
        need = f"ceil({self.least} * ({n} + {m}) / {self.scale + self.least}D - 1e-9)"
        return f"{self.scale} * least({n}, {m}) >= {self.least} * greatest({n}, {m}) and {q} >= {p} + {need} - {n} and {q} <= {p} + {m} - {need}"

    def overlap(self, n, m):
        """The least intersection with which sets of n and m shingles link."""
        return -(-self.least * (n + m) // (self.scale + self.least))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in lower-cased A-Z."""
    words = text.lower().split() if text else []
    return np.unique(window_hashes(word_hashes(words), width))


def _sketch(docs: DataFrame, cfg: JaccardConfig) -> np.ndarray:
    """How many documents hold a shingle of each hash bucket. It only orders the
    shingles, so that it also counts others of the bucket does no harm; all tasks use the same."""
    width, size = cfg.width, 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches):
            found, held = [], 0
            for text in batch.column(0).to_pylist():
                found.append((shingles(text, width) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                held += len(found[-1])
                if held > 4_000_000:
                    total += np.bincount(np.concatenate(found), minlength=size)
                    found, held = [], 0
            if held:
                total += np.bincount(np.concatenate(found), minlength=size)
        parts = np.minimum(total, 65535).astype(np.uint16).reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([x.tobytes() if x.any() else b"" for x in parts], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            for part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if raw:
                    sums[part] = sums.get(part, 0) + np.frombuffer(raw, np.uint16).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, schema).repartition(64, "part").mapInArrow(add, schema)
    out = np.zeros((64, size // 64), np.uint32)
    for part, raw in counts.collect():
        out[part] = np.frombuffer(raw, np.uint32)
    return out.reshape(-1)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set, whatever its order."""
    return int(as_long(mix64(s)).sum()), int(as_long(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).sum())


def _sets(docs: DataFrame, cfg: JaccardConfig, sketch) -> DataFrame:
    """(doc_id, text_key, n, f1, f2, prefix): size and fingerprint of each set, and its prefix in
    order."""
    width = cfg.width

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sketch.value
        for batch in slices(batches):
            n, f1, f2, prefix = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                for x, to in zip(fingerprint(s), (f1, f2), strict=True):
                    to.append(x)
                order = np.argsort(rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                prefix.append(s[order[: cfg.prefix(len(s))]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(prefix, pa.binary())], ["doc_id", "text_key", "n", "f1", "f2", "prefix"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text")).mapInArrow(make, "doc_id long, text_key long, n int, f1 long, f2 long, prefix binary")


def _index(classes: DataFrame, cfg: JaccardConfig, sketch, shards: int) -> DataFrame:
    """The lists with two sets at least: (token, id, n, p, cell) and hub_id,
    hub_n, hub_p, the entry of the smallest id of the cell. Entries travel packed, a row for each task, batch and shard."""

    def cells(e: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The part of its list in which an entry lies; only very long lists have more than one."""
        parts = 1 + rank[(e["token"] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] // np.uint32(cfg.hot)
        return mix64(np.ascontiguousarray(e["id"]).view(np.uint64)) % parts.astype(np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sketch.value
        for batch in slices(batches):
            prefixes = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            if not prefixes:
                continue
            lengths = np.array([len(x) for x in prefixes])
            out = np.empty(lengths.sum(), ENTRY)
            out["token"] = np.concatenate(prefixes)
            out["id"] = np.repeat(batch.column(0).to_numpy(), lengths)
            out["n"] = np.repeat(batch.column(1).to_numpy(), lengths)
            out["p"] = np.arange(len(out)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            shard = (mix64(out["token"] + cells(out, rank)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            out, shard = out[order], shard[order]
            at = np.flatnonzero(np.diff(shard, prepend=-1))
            ends = np.append(at[1:], len(out))
            yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array([out[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())], ["shard", "entries"])

    def lists(rows: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x, ENTRY) for x in rows.column("entries").to_pylist()])
        cell = cells(e, sketch.value)
        order = np.lexsort((e["id"], cell, e["token"]))
        e, cell = e[order], cell[order]
        fresh = np.ones(len(e), bool)
        fresh[1:] = (e["token"][1:] != e["token"][:-1]) | (cell[1:] != cell[:-1])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(e)))
        hub = np.repeat(e[first], size)
        # A split list may have its partners in another cell.
        live = np.repeat(size > 1, size) | (sketch.value[(e["token"] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] >= cfg.hot)
        e, hub, cell = e[live], hub[live], cell[live]
        own = {c: np.ascontiguousarray(e[c]) for c in ("id", "n", "p")}
        return pa.table({"token": as_long(np.ascontiguousarray(e["token"])), **own, "cell": cell.astype(np.int32), **{f"hub_{c}": np.ascontiguousarray(hub[c]) for c in own}})

    packed = classes.select("id", "n", "prefix").mapInArrow(deal, "shard int, entries binary")
    return packed.groupBy("shard").applyInArrow(lists, "token long, id long, n int, p int, cell int, hub_id long, hub_n int, hub_p int")


def _needed_sets(docs: DataFrame, ids: DataFrame, classes: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """(id, set) of the classes with these ids, from their documents. A membership filter of fixed
    size spares most other documents."""
    width = cfg.width
    wanted = written(classes.join(ids, "id", "left_semi").select("id", "doc_id", "f1", "f2", "n"), "jac-wanted")
    bits = membership(wanted, "doc_id")
    shared = session_broadcast(docs.sparkSession, bits, bits.nbytes, 1 << 23)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(pa.array(may_hold(shared.value, batch.column(1).to_numpy())))
            if batch.num_rows:
                sets = [shingles(x, width) for x in batch.column(2).to_pylist()]
                f1, f2 = zip(*map(fingerprint, sets), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "f1", "f2", "n", "set"])

    rows = docs.filter("doc_id is not null").select("doc_id", slot_of(F.col("doc_id")).alias("slot"), F.col("text").cast("binary").alias("text"))
    key = ["doc_id", "f1", "f2", "n"]
    rows = rows.mapInArrow(make, "doc_id long, f1 long, f2 long, n int, set binary").join(wanted, key)
    return rows.groupBy(*key, "id").agg(F.first("set").alias("set")).select("id", "set")


def _intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n, m, both) for pairs(a, b): sizes of the sets and of their intersection."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, m, both = [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                z = np.concatenate([x, y])
                z.sort()
                n.append(len(x))
                m.append(len(y))
                both.append(int((z[1:] == z[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (n, m, both))], ["a", "b", "n", "m", "both"])

    rows = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, n long, m long, both long")


def _against_hubs(pairs: DataFrame, sets: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """(a, b, n, m, both, difference): each set a against its hub b; the difference holds a's extra
    shingles and, marked, those it lacks. A hub is copied once for each `hub_rows` of its sets, so
    none of its copies meets more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                extra, lacks = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
                out.append((len(x), len(y), len(x) - len(extra), np.concatenate([extra, ~lacks]).tobytes()))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["a", "b", "n", "m", "both", "difference"])

    cells = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / cfg.hub_rows).cast("int").alias("cells")), "jac-hubs")
    hubs = sets.select(F.col("id").alias("b"), F.col("set").alias("y")).join(cells, "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    rows = pairs.join(cells, "b").select("a", "b", F.pmod(F.xxhash64("a"), "cells").cast("int").alias("cell"))
    rows = rows.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(hubs, ["b", "cell"])
    return rows.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, n long, m long, both long, difference binary")


def derived(n: np.ndarray, m: int, both: np.ndarray, component: np.ndarray, difference: list[bytes], cfg: JaccardConfig) -> tuple[np.ndarray, int]:
    """For sets of one hub of size m: the first set that links reach from each, and the set that
    links with most. Sets of one component count as linked."""
    size = len(n)
    tokens = [np.frombuffer(x, np.uint64) for x in difference]
    who, flat = np.repeat(np.arange(size), [len(t) for t in tokens]), np.concatenate(tokens)
    order = np.argsort(flat, kind="stable")
    who, flat = who[order], flat[order]
    cuts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.array([], np.int64)
    times = np.diff(np.append(cuts, len(flat)))
    shared = np.zeros((size, size), np.int32)
    for a, k in zip(cuts[times > 1].tolist(), times[times > 1].tolist(), strict=True):
        shared[np.ix_(who[a : a + k], who[a : a + k])] += 1
    lacks = m - both
    inter = m - lacks[:, None] - lacks[None, :] + shared
    link = cfg.scale * inter >= cfg.least * (n[:, None] + n[None, :] - inter)
    pivot = int(link.sum(axis=1).argmax())
    link |= component[:, None] == component[None, :]
    low = np.arange(size)
    while True:
        near = np.where(link, low[None, :], size).min(axis=1)
        near = np.minimum(near, near[near])
        if (near == low).all():
            return low, pivot
        low = near


def parts_of(which: Column, block: int, most: int) -> Column:
    """Parts of about `block` sets and `most` bytes of differences, of two sets at least."""
    count, size = F.count(F.when(which, 1)), F.coalesce(F.sum(F.when(which, F.length("difference"))), F.lit(0))
    return F.greatest(F.ceil(count / block), F.least(F.ceil(size / most), F.ceil(count / 2))).cast("int")


def family_cells(rows: DataFrame, cfg: JaccardConfig, shards: int, level: int) -> DataFrame:
    """(kind, a, b) of families cut in cells of a block: edges inside the cells (kind 0), and of
    each cell the best linked set a of hub b, kind 1 if the family has several cells, else 2."""

    def derive(rows: pa.Table) -> pa.Table:
        groups: dict[tuple, list[int]] = {}
        for r, k in enumerate(zip(rows.column("b").to_pylist(), rows.column("cell").to_pylist(), strict=True)):
            groups.setdefault(k, []).append(r)
        ids, n, m, both, comp, cells = (rows.column(c).to_numpy() for c in ("a", "n", "m", "both", "component", "cells"))
        difference = rows.column("difference").to_pylist()
        out = []
        for (hub, _), members in groups.items():
            r = np.array(members)
            if cells[r[0]] == 1 and not level and (comp[r] == comp[r[0]]).all():
                continue
            low, pivot = derived(n[r], int(m[r[0]]), both[r], comp[r], [difference[x] for x in members], cfg)
            moved = np.flatnonzero(low != np.arange(len(r)))
            out.append(np.column_stack([np.zeros(len(moved), np.int64), ids[r[moved]], ids[r[low[moved]]]]))
            out.append(np.array([[1 if cells[r[0]] > 1 else 2, ids[r[pivot]], hub]]))
        found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        return pa.table({"kind": found[:, 0].astype(np.int32), "a": found[:, 1], "b": found[:, 2]})

    size = rows.groupBy("b").agg(parts_of(F.lit(True), cfg.family_block, cfg.family_bytes).alias("cells"))
    rows = rows.join(size, "b").withColumn("cell", F.pmod(F.xxhash64("a", F.lit(level)), "cells").cast("int"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("b", "cell"), F.lit(4 * shards)).cast("int"))
    return rows.select("shard", "a", "b", "n", "m", "both", "difference", "component", "cell", "cells").groupBy("shard").applyInArrow(derive, "kind int, a long, b long")


def family_strays(rows: DataFrame, cfg: JaccardConfig, shards: int) -> DataFrame:
    """(a, b): edges of sets that are not in their hub's component (`stray`), which meet all of
    their family: each block of strays each block of the others."""
    block = max(1, cfg.family_block // 2)

    def derive(rows: pa.Table) -> pa.Table:
        groups: dict[tuple, list[int]] = {}
        for r, k in enumerate(zip(*(rows.column(c).to_pylist() for c in ("b", "i", "j")), strict=True)):
            groups.setdefault(k, []).append(r)
        ids, n, m, both, comp = (rows.column(c).to_numpy() for c in ("a", "n", "m", "both", "component"))
        difference = rows.column("difference").to_pylist()
        out = [np.zeros((0, 2), np.int64)]
        for members in groups.values():
            r = np.array(members)
            low, _ = derived(n[r], int(m[r[0]]), both[r], comp[r], [difference[x] for x in members], cfg)
            moved = np.flatnonzero(low != np.arange(len(r)))
            out.append(np.column_stack([ids[r[moved]], ids[r[low[moved]]]]))
        found = np.concatenate(out)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    size = rows.groupBy("b").agg(parts_of(F.lit(True), block, cfg.family_bytes // 2).alias("cells"), parts_of(F.col("stray"), block, cfg.family_bytes // 2).alias("parts")).filter("parts > 0")
    rows = rows.join(size, "b")
    place = lambda of: F.pmod(F.xxhash64("a", F.lit("stray")), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    columns = ["a", "b", "n", "m", "both", "difference", "component"]
    strays = rows.filter("stray").select(*columns, place("parts").alias("i"), every("cells").alias("j"))
    others = rows.filter("not stray").select(*columns, every("parts").alias("i"), place("cells").alias("j"))
    # A stray also stands among the others, for strays of other parts.
    both = rows.filter("stray").select(*columns, every("parts").alias("i"), place("cells").alias("j"))
    met = strays.unionByName(others).unionByName(both).withColumn("shard", F.pmod(F.xxhash64("b", "i", "j"), F.lit(4 * shards)).cast("int"))
    return met.groupBy("shard").applyInArrow(derive, "a long, b long")


def _within_families(checked: DataFrame, links: DataFrame, labels: DataFrame, sets: DataFrame, cfg: JaccardConfig, shards: int) -> DataFrame | None:
    """(a, b): edges that connect what links connect within each family; None if there are none."""
    rows = checked.join(labels.select(F.col("id").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    spread = rows.groupBy("b").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    rows = written(rows.join(spread.select("b"), "b"), "jac-families")
    edges, tops, level, part = None, None, 0, rows
    while True:
        found = written(family_cells(part, cfg, shards, level), "jac-cells")
        fresh = found.filter("kind = 0").select("a", "b")
        edges = fresh if edges is None else edges.unionByName(fresh)
        # A family that was cut, by sets or by bytes, ends at a level of its own.
        if level:
            ended = found.filter("kind = 2").select(F.col("a").alias("top"), "b")
            tops = ended if tops is None else tops.unionByName(ended)
        pivots = found.filter("kind = 1").select("a", "b")
        if not pivots.take(1):
            break
        part, level = rows.join(pivots, ["a", "b"], "left_semi"), level + 1
    if level:
        # Each family that was cut anew against its best linked set.
        pairs = written(rows.join(tops, "b").filter("a <> top").select("a", F.col("top").alias("b")), "jac-tops")
        again = written(_against_hubs(pairs, sets, cfg), "jac-again")
        edges = edges.unionByName(again.filter(_linked(cfg)).select("a", "b"))
        own = components(links.unionByName(edges)).select("id", F.col("component").alias("now"))
        again = again.join(own.withColumnRenamed("id", "a"), "a", "left").withColumn("component", F.coalesce("now", "a")).drop("now")
        again = again.join(own.withColumnRenamed("id", "b"), "b", "left").withColumn("stray", F.col("component") != F.coalesce("now", "b")).drop("now")
        edges = edges.unionByName(written(family_strays(again, cfg, shards), "jac-strays"))
    return edges if edges.take(1) else None


def _linked(cfg: JaccardConfig):
    return F.expr(f"{cfg.scale} * both >= {cfg.least} * (n + m - both)")


def _across(index: DataFrame, labels: DataFrame, families: DataFrame, cfg: JaccardConfig, shards: int) -> DataFrame:
    """(kind, a, b, n, m): pairs (kind 0) in different components and families that pass the filters on
    size, position and number of shared prefix shingles, each list walked block by block; of lists
    with too many, the sets a of these pairs with the first, b, as their hub (kind 1)."""

    def walk(rows: pa.Table) -> pa.Table:
        token, other, block, ids, n, p, comp, cell, kin, left_of, right_of = (rows.column(c).to_numpy() for c in ("token", "other", "cell_b", "id", "n", "p", "component", "cell", "family", "before", "after"))
        order = np.lexsort((p, n, block, other, token))
        token, other, block, ids, n, p, comp, cell, kin, left_of, right_of = (x[order] for x in (token, other, block, ids, n.astype(np.int64), p.astype(np.int64), comp, cell, kin, left_of, right_of))
        first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (other[1:] != other[:-1]) | (block[1:] != block[:-1])])) if len(token) else np.array([], np.int64)
        size = np.diff(np.append(first, len(token)))
        # Lists of two, the most common, at once.
        x, y = first[size == 2] + 1, first[size == 2]
        need = cfg.overlap(n[x], n[y])
        fine = (comp[x] != comp[y]) & (kin[x] != kin[y]) & (cfg.scale * n[y] >= cfg.least * n[x]) & (p[y] >= p[x] + need - n[x]) & (p[y] <= p[x] + n[y] - need) & ((other[x] < 0) | (cell[x] != cell[y]))
        fine &= np.minimum(left_of[x], left_of[y]) + 1 + np.minimum(right_of[x], right_of[y]) >= cfg.shared_of(n[x], n[y])
        left, right, crowds = [x[fine]], [y[fine]], [np.zeros((0, 2), np.int64)]
        for a, k in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            v, q, c, s, f, l, r = (z[a : a + k] for z in (n, p, comp, cell, kin, left_of, right_of))
            if (c == c[0]).all() or (f == f[0]).all():
                continue
            at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            blocks = list(zip(v[at].tolist(), at.tolist(), [*at[1:].tolist(), k], strict=True))
            # The largest family of the list is done with itself: only the others walk the list.
            names, times = np.unique(f, return_counts=True)
            main = f == names[times.argmax()]
            one, two, held, met = [], [], 0, np.zeros(k, bool)
            for x in np.flatnonzero(~main).tolist():
                for m, lo, hi in blocks:
                    if cfg.scale * min(m, v[x]) < cfg.least * max(m, v[x]):
                        continue
                    need = cfg.overlap(int(v[x]), m)
                    lo, hi = lo + np.searchsorted(q[lo:hi], [q[x] + need - v[x], q[x] + m - need + 1])
                    y = np.arange(lo, hi)
                    most = np.minimum(l[x], l[y]) + 1 + np.minimum(r[x], r[y])
                    y = y[(most >= cfg.shared_of(v[x], m)) & (main[y] | (y < x)) & (c[y] != c[x]) & (f[y] != f[x]) & ((other[a] < 0) | (s[y] != s[x]))]
                    met[y] = True
                    met[x] |= len(y) > 0
                    held += len(y)
                    if held <= cfg.crowd * k:
                        one.append(np.full(len(y), a + x))
                        two.append(a + y)
            if held <= cfg.crowd * k:
                left += one
                right += two
            else:
                i = ids[a : a + k][met]
                crowds.append(np.column_stack([i, np.full(len(i), i.min())])[i != i.min()])
        x, y = np.concatenate(left), np.concatenate(right)
        swap = ids[x] > ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        order = np.lexsort((ids[y], ids[x]))
        x, y = x[order], y[order]
        at = np.flatnonzero(np.concatenate([[True], (ids[x[1:]] != ids[x[:-1]]) | (ids[y[1:]] != ids[y[:-1]])])) if len(x) else np.array([], np.int64)
        times = np.diff(np.append(at, len(x)))
        crowd = np.unique(np.concatenate(crowds), axis=0)
        none, kind = np.zeros(len(crowd), np.int64), np.repeat(np.array([0, 1], np.int32), [len(at), len(crowd)])
        found = (ids[x[at]], crowd[:, 0]), (ids[y[at]], crowd[:, 1]), (n[x[at]], none), (n[y[at]], none), (times, none)
        return pa.table({"kind": kind, **{c: np.concatenate(v) for c, v in zip(("a", "b", "n", "m", "shared"), found, strict=True)}})

    rows = index.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = rows.join(families, "id", "left").withColumn("family", F.coalesce("family", "id"))
    own = Window.partitionBy("id")
    rows = rows.withColumn("before", F.row_number().over(own.orderBy("p")) - 1).withColumn("after", F.count("*").over(own).cast("int") - F.col("before") - 1)
    many = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("cell").alias("last")).filter("lo < hi").select("token", "last")
    rows = rows.join(many, "token").select("token", "id", "n", "p", "component", "family", "before", "after", "cell", "last")
    # A list in one cell meets itself; each entry of a split list also goes to every other cell.
    own = rows.select("token", "id", "n", "p", "component", "family", "before", "after", "cell", F.lit(-1).alias("other"), F.col("cell").alias("cell_b"))
    mixed = rows.filter("last > 0").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("last")))).filter("with <> cell")
    mixed = mixed.select("token", "id", "n", "p", "component", "family", "before", "after", "cell", F.least("cell", "with").alias("other"), F.greatest("cell", "with").alias("cell_b"))
    rows = own.unionByName(mixed).withColumn("shard", F.pmod(F.xxhash64("token", "other", "cell_b"), F.lit(shards)).cast("int"))
    pairs = rows.groupBy("shard").applyInArrow(walk, "kind int, a long, b long, n long, m long, shared long")
    pairs = pairs.filter("a <> b").groupBy("kind", "a", "b", "n", "m").agg(F.sum("shared").alias("shared"))
    return pairs.filter(F.expr(f"kind = 1 or shared >= {cfg.shared('n', 'm')}")).select("kind", "a", "b", "n", "m")


def _answers_needed(pairs: DataFrame, hubs: DataFrame, sets: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Drops the pairs whose answer follows from their hubs' answer."""
    a, b = (hubs.select(F.col("id").alias(c), F.col("hub").alias(f"hub_{c}"), F.col("beyond").alias(f"beyond_{c}")) for c in "ab")
    rows = pairs.join(a, "a", "left").join(b, "b", "left").withColumn("x", F.coalesce("hub_a", "a")).withColumn("y", F.coalesce("hub_b", "b"))
    rows = written(rows.select("a", "b", "n", "m", F.least("x", "y").alias("ha"), F.greatest("x", "y").alias("hb"), (F.coalesce("beyond_a", F.lit(0)) + F.coalesce("beyond_b", F.lit(0))).alias("beyond")), "jac-across")
    known = _intersections(rows.filter("beyond > 0 and ha <> hb").select(F.col("ha").alias("a"), F.col("hb").alias("b")).distinct(), sets)
    known = known.groupBy(F.col("a").alias("ha"), F.col("b").alias("hb")).agg(F.max("both").alias("hubs_share"))
    open_ = F.expr(f"hubs_share is null or {cfg.scale + cfg.least} * (hubs_share + beyond) >= {cfg.least} * (n + m)")
    return rows.join(known, ["ha", "hb"], "left").filter(open_).select("a", "b")


def grouped(docs: DataFrame, cfg: JaccardConfig | None = None, scratch: list[DataFrame] | None = None) -> DataFrame:
    """As `join`, with the checksum of each row's text and a number for its component, which tells
    components apart that share a repeated doc_id. `scratch` takes the tables that the result
    reads."""
    cfg = cfg or JaccardConfig()
    spark = docs.sparkSession
    ranks = _sketch(docs, cfg)
    sketch = session_broadcast(spark, ranks, ranks.nbytes, 4 << SKETCH_BITS)
    sets = written(_sets(docs, cfg, sketch), "jac-sets")
    alike = sets.filter("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "prefix")).alias("x"))
    classes = written(alike.select("f1", "f2", "n", F.monotonically_increasing_id().alias("id"), F.col("x.doc_id").alias("doc_id"), F.col("x.prefix").alias("prefix")), "jac-classes")
    entries = classes.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(entries * ENTRY.itemsize // cfg.shard_bytes) + 1)
    index = written(_index(classes, cfg, sketch, shards), "jac-index")
    used = [index]

    # Every set against the hub with which it shares most lists. A sixth of what a link needs makes a
    # relative: it need not link with the hub for its other answers to follow from it.
    index = index.withColumnRenamed("hub_id", "hub")
    first = index.filter("id <> hub").filter(cfg.reach("n", "p", "hub_n", "hub_p")).groupBy("id", "hub", "n", "hub_n").agg(F.count("*").alias("shared")).filter(F.expr(f"6 * shared >= {cfg.shared('n', 'hub_n')}"))
    # The hubs of a split list's cells against the smallest of them.
    split = index.groupBy("token").agg(F.max("cell").alias("last"), F.min("hub").alias("top")).filter("last > 0").select("token", "top")
    tops = index.select("token", "hub").distinct().join(split, "token").filter("hub <> top").groupBy(F.col("hub").alias("id"), F.col("top").alias("hub")).agg(F.count("*").alias("shared"))
    first = first.select("id", "hub", "shared").unionByName(tops).groupBy("id", "hub").agg(F.sum("shared").alias("shared"))
    first = first.groupBy("id").agg(F.max(F.struct("shared", (-F.col("hub")).alias("hub"))).alias("x"))
    first = written(first.select(F.col("id").alias("a"), (-F.col("x.hub")).alias("b")), "jac-first")
    needed = written(_needed_sets(docs, first.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes, cfg), "jac-needed")
    checked = written(_against_hubs(first, needed, cfg), "jac-checked")
    near = checked.filter(_linked(cfg)).select("a", "b", "n", "m", "both")
    links = near.select("a", "b")
    labels = components(links)
    used += [first, needed, checked]
    kin = _within_families(checked, links, labels, needed, cfg, shards)
    used.append(labels)
    if kin is not None:
        links = links.unionByName(kin)
        labels = components(links)
        used.append(labels)
    hubs = near.select(F.col("a").alias("id"), F.col("b").alias("hub"), (F.col("n") - F.col("both")).alias("beyond")).dropDuplicates(["id"])
    families = checked.select(F.col("a").alias("id"), F.col("b").alias("family"))
    families = families.unionByName(checked.select(F.col("b").alias("id")).distinct().join(families.select("id"), "id", "left_anti").withColumn("family", F.col("id")))
    families = families.groupBy("id").agg(F.min("family").alias("family"))

    # Then the pairs that still lie in different components.
    done = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = written(_across(index, labels, families, cfg, shards), "jac-pairs")
    used.append(across)
    pairs = across.filter("kind = 0").drop("kind").join(done, ["a", "b"], "left_anti")
    crowds = across.filter("kind = 1").select("a", "b")
    if crowds.take(1):
        held = written(_needed_sets(docs, crowds.select("a").unionByName(crowds.select(F.col("b").alias("a"))).select(F.col("a").alias("id")).distinct(), classes, cfg), "jac-needed")
        met = written(_against_hubs(crowds, held, cfg), "jac-crowds")
        used += [held, met]
        links = links.unionByName(met.filter(_linked(cfg)).select("a", "b"))
        labels = components(links)
        used.append(labels)
        kin = _within_families(met, links, labels, held, cfg, shards)
        if kin is not None:
            links = links.unionByName(kin)
            labels = components(links)
            used.append(labels)
        # What crowds have joined needs no pairs.
        for c in "ab":
            pairs = pairs.join(labels.select(F.col("id").alias(c), F.col("component").alias(f"in_{c}")), c, "left")
        pairs = pairs.filter("coalesce(in_a, a) <> coalesce(in_b, b)").select("a", "b", "n", "m")
    if pairs.take(1):
        rest = written(_answers_needed(pairs, hubs, needed, cfg), "jac-rest")
        more = written(_needed_sets(docs, rest.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes, cfg), "jac-needed")
        edges = links.unionByName(_intersections(rest, more).filter(_linked(cfg)).select("a", "b"))
        labels = components(edges)
        used += [rest, more]
    forget(*(t for t in used if t is not labels))
    if scratch is not None:
        scratch += [sets, classes, labels]

    # A component's name is its smallest doc_id.
    named = classes.select("f1", "f2", "n", "id", "doc_id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("name"))
    named = named.join(names, "component").select("f1", "f2", "n", "component", "name")
    out = sets.select("doc_id", "text_key", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    return out.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id")).alias("component_id"), F.col("component").alias("group"))


def join(docs: DataFrame, cfg: JaccardConfig | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the component is the smallest doc_id that
    links reach, itself included."""
    return grouped(docs, cfg).drop("text_key", "group")


def keep_one(docs: DataFrame, cfg: JaccardConfig | None = None) -> DataFrame:
    """One document of each component: that with the smallest doc_id and, of several rows of that
    id in it, with the smallest checksum of text, then of the whole row. Rows without doc_id and
    those without a word are in no component and stay."""
    scratch: list[DataFrame] = []
    found = written(grouped(docs, cfg, scratch).filter("doc_id is not null and n_shingles > 0"), "jac-kept")
    forget(*scratch)
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
    keep = written(first.select("x.*"), "jac-first-rows")
    held = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col("doc_id").isNotNull()
    rows = docs.select(whole_row(docs), F.col("doc_id"), F.xxhash64("text").alias("text_key"), held.alias("held"))
    out = rows.filter("held").join(keep.hint("shuffle_hash"), ["doc_id", "text_key"], "left_semi")
    # Only rows that repeat both id and text of a kept one are still several.
    again = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_key")
    again = written(again.join(keep, ["doc_id", "text_key"], "left_semi"), "jac-again")
    if again.take(1):
        twice = out.join(again, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        out = out.join(again, ["doc_id", "text_key"], "left_anti").select("row").unionByName(twice.select("row"))
    return out.select("row").unionByName(rows.filter("not held").select("row")).select("row.*")
