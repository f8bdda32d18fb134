"""Operator 7: mixing sources to target weights by Pareto order sampling, in DataFrame operations.

Sources get shares of all words by weight, none above `most` times its own words; what a source
cannot take is shared again by weight among the others until none is above (water filling, solved
at once from running sums in the order of cap over weight). Ranks and sums of sources come from ranges
of them, so that sources may be as many as documents. Within a source, documents are further
weighted by `merit`, by the same rule, which gives every document an expected number of copies.

The whole part of that number is certain: so many copies are taken. The rest is the inclusion
probability p of one more, and these are drawn by Pareto order sampling: with u uniform from the
document's id, documents rank by (u / (1 - u)) / (p / (1 - p)), and the first are taken until their
words fill what the source still lacks. Last, the one document left whose size is nearest to the
gap is taken, if that brings the source closer.

The running sum over a source does not need the source in one task: ranks fall in 4096 bins, sizes
are summed by bin before the shuffle, and only the rows of the bin in which the target lies are
ordered one by one. They are ranged in that order
first, so that many rows of one rank, as rows without doc_id are, need not stand in one task.

Cases: a null or empty text has no words and takes none; a very long text is one document like any
other and may be the one that fills the gap; null is a source of its own, the last in order; rows of
one id are drawn together, smaller ones first where the target cuts them, and equal rows count each; rows without doc_id share one rank; a source without words has target 0; an
empty table gives an empty mix; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, running_sums, whole_row, word_count, written

BINS = 4096


def length_merit(size: Column) -> Column:
    """1 below 100 words, 2 below 1000, 3 from there."""
    return F.when(size < 100, 1).when(size < 1000, 2).otherwise(3)


def filled(rows: DataFrame, within: list[str], weight: str, cap: str, total: str, name: str) -> DataFrame:
    """Adds `name`: least(cap, level * weight), with the level of each group at which they sum to
    its total. Rows need a cap above 0 and a weight above 0."""
    order = Window.partitionBy(*within).orderBy(F.col("__ratio"), F.col("__tie"))
    rows = rows.withColumn("__ratio", F.col(cap) / F.col(weight))
    rows = rows.withColumn("__before", F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("__level", (F.col(total) - F.col("__before")) / F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing)))
    first = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__tie", "__level"))).over(Window.partitionBy(*within))
    rows = rows.withColumn("__first", first)
    return rows.withColumn(name, F.coalesce(F.least(F.col(cap).cast("double"), F.col("__first.__level") * F.col(weight)), F.col(cap).cast("double"))).drop("__ratio", "__before", "__level", "__first")


def source_targets(classes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target) from (source, class_size): one row a source."""
    rows = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    rows = rows.select("source", "source_size", F.col("source").isNull().alias("last"), F.lit(1).alias("one"), (most * F.col("source_size")).alias("cap"))
    rows = running_sums(rows, ["last", "source"], {"rank": "one", "words": "source_size"}, "mix-sources")
    weight = F.array(*map(F.lit, weights))[(F.col("rank") % len(weights)).cast("int")]
    rows = written(rows.withColumn("weight", weight).withColumn("ratio", F.col("cap") / F.col("weight")), "mix-ranks")
    # As in filled, over all sources: in the order of ratio, the first that the level does not pass.
    levels = running_sums(rows.filter("cap > 0"), ["ratio", "rank"], {"capped": "cap", "weighed": "weight"}, "mix-ratios")
    levels = levels.withColumn("level", (F.col("all_words") - F.col("capped")) / (F.col("all_weighed") - F.col("weighed")))
    level = levels.filter("level <= ratio").agg(F.min(F.struct("ratio", "rank", "level")).alias("x")).first().x
    cap = F.col("cap").cast("double")
    target = cap if level is None else F.least(cap, F.lit(level["level"]) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number between 0 and 1 from the first 13 hex digits of a checksum of the key."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix:", merit=length_merit, carry: Column | None = None) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, copies, taken, and the column `carry`
    as row."""
    size = word_count(F.col("text"))
    own = [] if carry is None else ["row"]
    base = docs.select(*([] if carry is None else [carry.alias("row")]), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), size.alias("__size"))
    base = base.withColumn("__merit", merit(F.col("__size"))).withColumn("__u", uniform(F.col("__id"), seed)).withColumn("__row", F.monotonically_increasing_id())
    base = written(base, "mix-rows")
    rows = base.select(F.col("__row").alias("row"), F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__merit").alias("merit"), F.col("__u").alias("u"))

    classes = written(rows.groupBy("source", "merit").agg(F.sum("size").alias("class_size")), "mix-classes")
    targets = written(source_targets(classes, weights, most), "mix-targets")
    shares = classes.filter("class_size > 0").alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source"))
    shares = shares.select("c.source", "merit", "class_size", "target", F.expr("class_size * merit").alias("weight"), (most * F.col("class_size")).alias("cap"), F.col("merit").alias("__tie"))
    shares = filled(shares, ["source"], "weight", "cap", "target", "share").withColumn("expected", F.col("share") / F.col("class_size"))
    shares = shares.withColumn("whole", F.floor("expected")).withColumn("part", F.col("expected") - F.floor("expected"))
    shares = written(shares.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("class_size")).over(Window.partitionBy("source"))).select("source", "merit", "whole", "part", "rest"), "mix-shares")

    # Rank each document, and find the bin in which its source is full.
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    ranked = rows.alias("r").join(shares.alias("s"), F.expr("r.source <=> s.source and r.merit = s.merit"))
    ranked = ranked.select("row", "doc_id", "r.source", "size", "rest", F.when(F.col("part") > 0, odds).otherwise(F.lit(float("inf"))).alias("odds"))
    ranked = ranked.withColumn("bin", F.when(F.col("odds") == float("inf"), BINS).otherwise(F.least(F.floor(F.col("odds") / (1 + F.col("odds")) * BINS), F.lit(BINS - 1))).cast("int"))
    ranked = written(ranked, "mix-ranked")
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    bins = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
    cut = bins.filter("upto > rest").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
    cut = written(cut.select("source", F.col("x.bin").alias("cut"), F.col("x.before").alias("before")), "mix-cut")
    placed = ranked.alias("r").join(cut.alias("c"), F.expr("r.source <=> c.source"), "left").select("r.*", "cut", "before")
    placed = placed.filter(F.col("bin") < BINS)  # the others take whole copies only
    # The rows of the bin that holds the target, ranged in their order: sums of the ranges before and
    # a running sum inside each, so that rows of one rank need not stand in one task.
    order = ["source", "odds", "doc_id", "size", "row"]
    edge = placed.filter("bin = cut").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    edge = written(edge, "mix-bin")
    parts = edge.groupBy("part", "source").agg(F.sum("size").alias("words"))
    parts = parts.select("part", "source", (F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words")).alias("earlier"))
    edge = edge.alias("e").join(parts.alias("p"), F.expr("e.part = p.part and e.source <=> p.source")).select("e.*", "earlier")
    within = F.sum("size").over(Window.partitionBy("part", "source").orderBy("odds", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    edge = written(edge.withColumn("upto", F.col("before") + F.col("earlier") + within), "mix-edge")
    inside = edge.filter("upto <= rest")

    # The one document outside that best fills each source's gap.
    gaps = edge.groupBy("source").agg(F.first("rest").alias("rest"), F.greatest(F.first("before"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.first("before"))).alias("full"))
    gaps = gaps.select("source", (F.col("rest") - F.col("full")).alias("gap"))
    outside = placed.filter("bin > cut").select("row", "doc_id", "source", "size").unionByName(edge.filter("upto > rest").select("row", "doc_id", "source", "size"))
    last = outside.alias("o").join(gaps.alias("g"), F.expr("o.source <=> g.source")).filter("size > 0 and abs(size - gap) < gap")
    last = last.groupBy("o.source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("doc_id"), F.col("row"))).alias("x")).select(F.col("x.row").alias("row"))

    drawn = placed.filter(F.col("bin") < F.coalesce("cut", F.lit(BINS))).select("row")
    drawn = written(drawn.unionByName(inside.select("row")).unionByName(last).withColumn("more", F.lit(1)), "mix-drawn")
    forget(classes, ranked, cut, edge)
    out = base.join(drawn.withColumnRenamed("row", "__row"), "__row", "left").alias("b")
    out = out.join(shares.select(F.col("source").alias("__s"), F.col("merit").alias("__m"), "whole"), F.expr("b.__source <=> __s and b.__merit = __m"), "left")
    out = out.join(targets.select(F.col("source").alias("__t"), "source_size", "target"), F.expr("b.__source <=> __t"), "left")
    copies = F.when(F.col("__size") > 0, F.coalesce("whole", F.lit(0)) + F.coalesce("more", F.lit(0))).otherwise(0).cast("long")
    return out.select(*[f"b.{c}" for c in own], F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("__size") * copies).alias("taken"))


def resampled(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix:") -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns. A document without
    words has no size to weigh and is not taken."""
    rows = mix(docs, weights, most, seed, carry=whole_row(docs)).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
    FROM documents
), m AS (SELECT *, CASE WHEN size < 100 THEN 1 WHEN size < 1000 THEN 2 ELSE 3 END AS merit FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM m GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, [5, 2, 1][(i - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, cap::DOUBLE / w AS ratio FROM s2 WHERE cap > 0),
s4 AS (
    SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(w) OVER (ORDER BY ratio, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s3
), s5 AS (SELECT min_by(level, (ratio, i)) AS level FROM s4 WHERE level <= ratio),
targets AS (
    SELECT source, source_size, coalesce(least(cap::DOUBLE, s5.level * w), cap::DOUBLE) AS target FROM s4, s5
    UNION ALL SELECT source, source_size, 0 FROM s2 WHERE cap = 0
), c0 AS (SELECT source, merit, CAST(sum(size) AS BIGINT) AS class_size FROM m GROUP BY ALL HAVING sum(size) > 0),
c1 AS (SELECT c0.*, target, class_size * merit AS w, 3 * class_size AS cap, (3 * class_size)::DOUBLE / (class_size * merit) AS ratio FROM c0 JOIN targets ON c0.source IS NOT DISTINCT FROM targets.source),
c2 AS (
    SELECT *, (target - coalesce(sum(cap) OVER (PARTITION BY source ORDER BY ratio, merit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER (PARTITION BY source ORDER BY ratio, merit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM c1
), c3 AS (SELECT source, min_by(level, (ratio, merit)) AS level FROM c2 WHERE level <= ratio GROUP BY source),
c4 AS (
    SELECT c2.source, merit, class_size, target, coalesce(least(cap::DOUBLE, c3.level * w), cap::DOUBLE) / class_size AS expected
    FROM c2 LEFT JOIN c3 ON c2.source IS NOT DISTINCT FROM c3.source
), shares AS (
    SELECT source, merit, floor(expected) AS whole, expected - floor(expected) AS part,
        target - sum(floor(expected) * class_size) OVER (PARTITION BY source) AS rest FROM c4
), ranked AS (
    SELECT r, doc_id, m.source, size, whole, rest, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) ELSE 'infinity'::DOUBLE END AS odds
    FROM m JOIN shares ON m.source IS NOT DISTINCT FROM shares.source AND m.merit = shares.merit
), summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size, r ROWS UNBOUNDED PRECEDING) AS upto FROM ranked),
gaps AS (SELECT source, max(rest) - coalesce(max(CASE WHEN upto <= rest AND odds < 'infinity'::DOUBLE THEN upto END), 0) AS gap FROM summed GROUP BY source),
last AS (
    SELECT min_by(r, (abs(size - gap), doc_id, r)) AS r FROM summed JOIN gaps ON summed.source IS NOT DISTINCT FROM gaps.source
    WHERE upto > rest AND odds < 'infinity'::DOUBLE AND size > 0 AND abs(size - gap) < gap GROUP BY summed.source
), copies AS (
    SELECT r, size * (whole + CASE WHEN upto <= rest AND odds < 'infinity'::DOUBLE OR r IN (SELECT r FROM last) THEN 1 ELSE 0 END) AS taken FROM summed
)
SELECT m.doc_id, CAST(m.size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM m JOIN targets ON m.source IS NOT DISTINCT FROM targets.source LEFT JOIN copies USING (r)
"""
