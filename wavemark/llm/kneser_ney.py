"""Operator 4: quality filter by an interpolated modified Kneser-Ney character n-gram model.

Trusted documents (those the labels call good) are split by a checksum of their id: most train the
model, the rest calibrates the cut-offs, so a document's own n-grams never flatter the perplexities
from which a quantile is taken. The model is of characters inside words (runs of other than ASCII
white space): each word stands after start signs and is closed by an end sign, and its characters
are code points as they are. A text's perplexity is that of all signs of its words. Nothing is
folded or pruned: every n-gram of all trusted text has its row, and the tables grow with it.

All texts are read once and packed: each task puts its documents, compressed, into groups of bounded
size, and each group lists its distinct n-grams. The packed table is bucketed by group. Then

* training counts the n-grams of trusted documents, combined in tasks, and joins the counts of each
  order, shard to shard, on context and on suffix: continuation counts, discounts, the mass left to
  lower orders and their probability;
* scoring joins the distinct n-grams that the groups ask for to these tables, order by order, backing
  off where there is none; the prices are joined to the groups that asked, and each group meets its
  prices bucket to bucket, so the texts are never shuffled. Costs are whole numbers, so equal texts
  score equally.

No table of the model reaches the driver or is broadcast, however small: all of these joins are
sort-merge joins. An n-gram in every text is one row a group. A text of any length is priced in slices of its characters.

A document is kept if its perplexity is at most the quantile of its language's calibration
documents. A language with fewer than `min_calibration` of these uses the quantile of all together.

Cases: a null or empty text, or one of white space, has no perplexity (null) and is not kept; a null
language is a language of its own; equal rows score equally and each stays a row; an id whose labels
disagree is not trusted; without trusted documents, or without calibration documents, nothing can be
said against any text and every one with a word is kept; other columns pass through untouched,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, forget, forget_bucketed, whole_row, written

#: What stands before a word and what ends it: white space, which no word holds.
START, END = 0x20, 0x0D
#: Costs are counted in these parts of a bit.
PARTS = 1 << 20
#: Characters looked at together.
SLICE = 1 << 18
#: Compression of packed texts.
CODEC = ("zstd", 3)


@dataclass(frozen=True)
class KneserNeyConfig:
    """order: characters of an n-gram, 16 at most; quantile and min_calibration: the cut-off; held: of
    how many trusted documents one calibrates; pack_bytes: text packed in one row; group_bytes and
    group_grams: text and distinct n-grams after which a group ends."""

    order: int = 5
    quantile: float = 0.98
    min_calibration: int = 50
    held: int = 4
    pack_bytes: int = 1 << 20
    group_bytes: int = 64 << 20
    group_grams: int = 1 << 20


def multipliers(order: int) -> np.ndarray:
    """Odd 64-bit factors, one for each place of an n-gram."""
    return np.random.default_rng(4).integers(1 << 63, size=16, dtype=np.uint64)[:order] * np.uint64(2) + np.uint64(1)


def gram_hashes(grams: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given place by place."""
    return sum(c.astype(np.uint64) * m for c, m in zip(grams, multipliers(len(grams)), strict=True))


def grams_in(points: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The n-grams of a text's code points, slice by slice: where their last signs stand, in order, and
    their signs place by place. White space has to end the text."""
    space = (points == START) | (points - np.uint32(9) < 5)
    for a in range(0, len(points), SLICE):
        b, back = min(a + SLICE, len(points)), min(a, order)
        p = np.concatenate([np.full(order - back, START, np.uint32), points[a - back : b]])
        s = np.concatenate([np.ones(order - back, bool), space[a - back : b]])
        at = np.flatnonzero(~(s[order:] & s[order - 1 : -1])) + order
        grams = [np.where(s[at], np.uint32(END), p[at])]
        inside = np.ones(len(at), bool)
        for j in range(1, order):
            inside &= ~s[at - j]
            grams.insert(0, np.where(inside, p[at - j], np.uint32(START)))
        yield at + (a - order), grams


def gram_texts(grams: np.ndarray) -> list[str]:
    """Rows of code points as strings."""
    text, order = np.ascontiguousarray(grams).tobytes().decode("utf-32-le"), grams.shape[1]
    return [text[i : i + order] for i in range(0, len(text), order)]


class Distinct:
    """Distinct n-grams and how often each was added."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.waiting = 0

    def add(self, points: np.ndarray, order: int) -> None:
        for _, grams in grams_in(points, order):
            code, found = pd.factorize(gram_hashes(grams))
            first = np.empty(len(found), np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            self.parts.append((found, np.stack([c[first] for c in grams], 1), np.bincount(code, minlength=len(found))))
            self.waiting += len(found)
            if self.waiting > self.size + (1 << 18):
                self.merge()

    def merge(self) -> None:
        found, grams, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        found, first, code = np.unique(found, return_index=True, return_inverse=True)
        self.parts = [(found, grams[first], np.bincount(code, n, len(found)).astype(np.int64))]
        self.size, self.waiting = len(found), 0

    def taken(self, rows: int = 50_000) -> Iterator[tuple[list[str], np.ndarray]]:
        """All of them, some rows at a time; nothing is left."""
        if self.parts:
            self.merge()
            _, grams, n = self.parts[0]
            for i in range(0, len(n), rows):
                yield gram_texts(grams[i : i + rows]), n[i : i + rows]
        self.parts, self.size, self.waiting = [], 0, 0


#: What is known of each packed document.
ABOUT = pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("text_key", pa.int64()), ("chars", pa.int64()), ("signs", pa.int64())])


def deal(docs: DataFrame, cfg: KneserNeyConfig) -> DataFrame:
    """Rows of packed documents (group, part, texts, size, about): texts, each ended by a line feed,
    compressed from `size` bytes. And rows (group, grams) of the distinct n-grams of a group."""

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        a = 0
        while a < batch.num_rows:
            b = a + max(1, int(np.searchsorted(np.cumsum(size[a:]), cfg.pack_bytes, "right")))
            yield batch.slice(a, b - a)
            a = b

    def row(group: int, part: int | None, texts: bytes | None, size: int | None, about: pa.Array | None, grams: list[str] | None) -> pa.RecordBatch:
        one = [pa.array([x], t) for x, t in ((group, pa.int64()), (part, pa.int32()), (texts, pa.binary()), (size, pa.int64()))]
        held = pa.ListArray.from_arrays(pa.array([0, len(about)], pa.int32()), about) if about is not None else pa.nulls(1, pa.list_(ABOUT))
        return pa.RecordBatch.from_arrays([*one, held, pa.array([grams], pa.list_(pa.string()))], ["group", "part", "texts", "size", "about", "grams"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec = pa.Codec(CODEC[0], compression_level=CODEC[1])
        group, part, filled, seen = TaskContext.get().partitionId() << 33, 0, 0, Distinct()
        for piece in chain.from_iterable(map(pieces, batches)):
            texts = [x or "" for x in piece.column("text").to_pylist()]
            text = "\n".join([*texts, ""])
            chars = np.fromiter(map(len, texts), np.int64, len(texts))
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            signs = np.zeros(len(texts), np.int64)
            ends = np.cumsum(chars + 1)
            for at, _ in grams_in(points, 1):
                signs += np.bincount(np.searchsorted(ends, at, "right"), minlength=len(texts))
            raw = text.encode()
            about = pa.StructArray.from_arrays([piece.column("doc_id"), piece.column("lang"), piece.column("text_key"), pa.array(chars), pa.array(signs)], fields=list(ABOUT))
            yield row(group, part, codec.compress(raw, asbytes=True), len(raw), about, None)
            seen.add(points, cfg.order)
            part, filled = part + 1, filled + len(raw)
            if filled >= cfg.group_bytes or seen.size >= cfg.group_grams:
                yield from (row(group, None, None, None, None, grams) for grams, _ in seen.taken())
                group, part, filled = group + 1, 0, 0
        yield from (row(group, None, None, None, None, grams) for grams, _ in seen.taken())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pack, "group long, part int, texts binary, size long, about array<struct<doc_id:bigint,lang:string,text_key:bigint,chars:bigint,signs:bigint>>, grams array<string>")


def unpacked(texts: bytes, size: int) -> np.ndarray:
    """Code points of packed texts."""
    raw = pa.Codec(*CODEC[:1]).decompress(texts, size, asbytes=True)
    return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)


def packed_documents(docs: DataFrame, cfg: KneserNeyConfig) -> DataFrame:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * size // cfg.group_bytes, 50_000))
    return bucketed(deal(docs, cfg), "kn-packed", "group", buckets)


def about_documents(packed: DataFrame) -> DataFrame:
    """(group, part, at, doc_id, lang, text_key, chars, signs): one row a document."""
    rows = packed.filter("part is not null").select("group", "part", F.posexplode("about").alias("at", "x"))
    return rows.select("group", "part", "at", "x.*")


def gram_counts(packed: DataFrame, ids: DataFrame, cfg: KneserNeyConfig) -> DataFrame:
    """(gram, n) over the documents with these doc_ids, combined in tasks only."""
    chosen = about_documents(packed).filter("signs > 0").join(ids, "doc_id", "left_semi").groupBy("group", "part").agg(F.collect_list("at").alias("chosen"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Distinct()

        def counted() -> Iterator[pa.RecordBatch]:
            for grams, n in seen.taken():
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["gram", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                texts, size, chars, some = (batch.column(c)[i] for c in range(4))
                chars = chars.values.to_numpy()
                wanted = np.zeros(len(chars), bool)
                wanted[some.values.to_numpy()] = True
                seen.add(unpacked(texts.as_py(), size.as_py())[np.repeat(wanted, chars + 1)], cfg.order)
                if seen.size >= cfg.group_grams:
                    yield from counted()
        yield from counted()

    rows = packed.filter("part is not null").join(written(chosen, "kn-chosen"), ["group", "part"])
    return rows.select("texts", "size", F.col("about.chars").alias("chars"), "chosen").mapInArrow(count, "gram string, n long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from how many n-grams occur once to four times;
    a plain half, one and three halves where these are too few to tell."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


class Model:
    """For each order k from 1: (gram, p) of the n-grams seen and (context, rest), the mass a context
    leaves to the order below; `floor` is what the lowest order leaves to any one sign."""

    def __init__(self, orders: list[tuple[DataFrame, DataFrame]], floor: float) -> None:
        self.orders, self.floor = orders, floor


def train(counts: DataFrame, cfg: KneserNeyConfig) -> Model | None:
    """The model of the n-grams counted in (gram, n); None without any. Lower orders count distinct
    left neighbours."""
    order = cfg.order
    level = written(counts.groupBy("gram").agg(F.sum("n").alias("n")), f"kn-count-{order}")
    if not level.take(1):
        return None
    levels = [level]
    for k in range(order - 1, 0, -1):
        levels.insert(0, written(levels[0].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"kn-count-{k}"))
    floor = 1.0 / (levels[0].count() + 1)  # one more for signs never seen
    out, below = [], None
    for k, level in enumerate(levels, 1):
        few = level.agg(*(F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5))).first()
        d1, d2, d3 = discounts(*few)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        seen = level.select("gram", "n", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
        contexts = seen.groupBy("context").agg(F.sum("n").alias("total"), F.sum(off).alias("mass")).select("context", "total", (F.col("mass") / F.col("total")).alias("rest"))
        contexts = written(contexts, f"kn-context-{k}")
        grams = seen.join(contexts.hint("merge"), "context")
        grams = grams.withColumn("lower", F.lit(floor)) if below is None else grams.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")).hint("merge"), "suffix")
        below = written(grams.select("gram", ((F.col("n") - off) / F.col("total") + F.col("rest") * F.col("lower")).alias("p")), f"kn-order-{k}")
        out.append((below, contexts.select("context", "rest")))
    forget(*levels)
    return Model(out, floor)


def gram_probabilities(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, p) for distinct n-grams of the model's order, seen or not: joined order by order from
    the lowest, each with what its context leaves to the one below."""
    order = len(model.orders)
    needed = [grams]
    for k in range(order - 1, 0, -1):
        needed.insert(0, needed[0].select(F.substring("gram", 2, k).alias("gram")).distinct())
    found = None
    for k, (rows, (seen, contexts)) in enumerate(zip(needed, model.orders, strict=True), 1):
        rows = rows.select("gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
        rows = rows.join(seen.hint("merge"), "gram", "left").join(contexts.hint("merge"), "context", "left")
        rows = rows.withColumn("lower", F.lit(model.floor)) if found is None else rows.join(found.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")).hint("merge"), "suffix")
        found = rows.select("gram", F.coalesce("p", F.coalesce("rest", F.lit(1.0)) * F.col("lower")).alias("p"))
        if k == order - 2:
            found = written(found, f"kn-asked-{k}")
    return found


def with_perplexity(packed: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang, text_key, has_words, perplexity): one row a document."""
    if model is None:
        return about_documents(packed).select("doc_id", "lang", "text_key", (F.col("signs") > 0).alias("has_words"), F.lit(None).cast("double").alias("perplexity"))
    order = len(model.orders)
    asked = packed.filter("grams is not null").select(F.col("group").alias("asker"), F.explode("grams").alias("gram"))
    priced = gram_probabilities(written(asked.select("gram").distinct(), "kn-asked"), model)
    prices = asked.join(priced.select("gram", F.round(-F.log2("p") * PARTS).cast("long").alias("bits")).hint("merge"), "gram")

    def score(texts: pa.Table, prices: pa.Table) -> pa.Table:
        known = np.frombuffer("".join(prices.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, order)
        known, bits = pd.Index(gram_hashes(list(known.T))), prices.column("bits").to_numpy()
        out = []
        for i in range(texts.num_rows):
            packed, size, about = (texts.column(c)[i] for c in ("texts", "size", "about"))
            about = about.values
            signs = about.field("signs").to_numpy()
            ends = np.cumsum(about.field("chars").to_numpy() + 1)
            total = np.zeros(len(about), np.int64)
            for at, grams in grams_in(unpacked(packed.as_py(), size.as_py()), order):
                if len(at):
                    doc = np.searchsorted(ends, at, "right")
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    total[doc[first]] += np.add.reduceat(bits[known.get_indexer(gram_hashes(grams))], first)
            perplexity = np.exp2(total / PARTS / np.maximum(signs, 1))
            out.append(pa.table({**{c: about.field(c) for c in ("doc_id", "lang", "text_key")}, "has_words": pa.array(signs > 0), "perplexity": pa.array(perplexity, mask=signs == 0)}))
        return pa.concat_tables(out)

    texts = packed.filter("part is not null").select("group", "texts", "size", "about")
    return texts.groupBy("group").cogroup(prices.groupBy("asker")).applyInArrow(score, "doc_id long, lang string, text_key long, has_words boolean, perplexity double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label of theirs calls good."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("worst")).filter("worst >= 1").select(F.col("doc_id").cast("long").alias("doc_id"))


def calibrates(cfg: KneserNeyConfig) -> Column:
    """Whether a trusted id is held out from training to set the cut-offs."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % cfg.held == cfg.held - 1


def thresholds(scored: DataFrame, labels: DataFrame, cfg: KneserNeyConfig) -> DataFrame:
    """(lang, threshold) for the languages with enough calibration documents, and the threshold of
    all together as a row whose column `pooled` is true."""
    held = scored.filter("perplexity is not null").join(trusted_ids(labels).filter(calibrates(cfg)), "doc_id", "left_semi")
    cut = F.percentile_approx("perplexity", cfg.quantile, 10_000).alias("threshold")
    own = held.groupBy("lang").agg(cut, F.count("*").alias("n")).filter(F.col("n") >= cfg.min_calibration)
    return own.select("lang", "threshold", F.lit(False).alias("pooled")).unionByName(held.agg(cut).select(F.lit(None).cast("string").alias("lang"), "threshold", F.lit(True).alias("pooled")))


def judged(docs: DataFrame, labels: DataFrame, cfg: KneserNeyConfig) -> DataFrame:
    """(doc_id, lang, text_key, perplexity, threshold, kept): one row a document."""
    packed = packed_documents(docs, cfg)
    model = train(gram_counts(packed, trusted_ids(labels).filter(~calibrates(cfg)), cfg), cfg)
    scored = written(with_perplexity(packed, model), "kn-scored")
    forget_bucketed(packed)
    cuts = written(thresholds(scored, labels, cfg), "kn-cuts", 1)
    spare = [x["threshold"] for x in cuts.filter("pooled").collect()]  # one row
    own = cuts.filter("not pooled").select(F.col("lang").alias("own_lang"), F.col("threshold").alias("own"))
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("own_lang")), "left")
    out = out.withColumn("threshold", F.coalesce("own", F.lit(spare[0] if spare else None).cast("double")))
    kept = F.col("has_words") & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "text_key", "perplexity", "threshold", kept.alias("kept"))


def quality(docs: DataFrame, labels: DataFrame, cfg: KneserNeyConfig | None = None) -> DataFrame:
    """One row a document: doc_id, lang, perplexity, threshold, kept."""
    return judged(docs, labels, cfg or KneserNeyConfig()).drop("text_key")


def keep_good(docs: DataFrame, labels: DataFrame, cfg: KneserNeyConfig | None = None) -> DataFrame:
    """The documents that pass, with their columns. A verdict depends on language and text alone, so
    rejected pairs of these are taken away, and repeated or null ids do not matter."""
    bad = judged(docs, labels, cfg or KneserNeyConfig()).filter("not kept").select("text_key", F.col("lang").alias("bad_lang"))
    bad = written(bad.distinct(), "kn-rejected").withColumnRenamed("text_key", "bad_key")
    rows = docs.select(whole_row(docs), F.xxhash64("text").alias("text_key"), F.col("lang").cast("string").alias("of_lang"))
    same = (F.col("text_key") == F.col("bad_key")) & F.col("of_lang").eqNullSafe(F.col("bad_lang"))
    return rows.join(bad.hint("shuffle_hash"), same, "left_anti").select("row.*")
