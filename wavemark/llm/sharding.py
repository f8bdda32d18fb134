"""Operator 2: shards as runs of the Hilbert curve over metadata, in DataFrame operations.

Language, source and size are quantised to 64 steps each: size by its logarithm, the others by the
share of rows before a value in its sort order, so that a frequent value takes much of the axis.
The three steps are the coordinates of a cell, and rows sort by the cell's index on the Hilbert
curve; neighbours on the curve are neighbours in every dimension, so a run of it, which is a shard
or a file, covers short ranges of all three and readers can skip it by any of them. Within a cell,
rows sort by the text's checksum, which keeps copies side by side, then by id.

The law is `rows`: runs are cut so that counts differ by one at most. Rows are dealt by ranges of
the whole sort key, so a cell that holds a third of all rows is split; each partition is written
with the place of its rows in it, and the sums of the partitions before give the global rank.

Steps are found without gathering values: they are counted, the counts are ranged by value, and
the sums of the ranges before give each value's place, as they do for rows.

Cases: a null text has no bytes and checksum 0, an empty one too but for its size; very long texts
share the last steps of their axis; null languages and sources are values of their own, the last of
their axis; equal rows take neighbouring slots; null ids sort first in their cell; with fewer rows
than shards some shards are empty; an empty table gives an empty result; other columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, free_name, rows_per_task, running_sums, whole_row, written

STEPS_BITS = 6


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """For each state of the curve in n dimensions and each corner of a cube, the corner's place on
    the curve and the state inside it. A state is the corner of entry and the direction of exit."""

    def turn(b: int, k: int) -> int:
        k %= n
        return (b >> k | b << (n - k)) & ((1 << n) - 1)

    def gray(i: int) -> int:
        return i ^ i >> 1

    def rank(g: int) -> int:
        i = 0
        while g:
            i ^= g
            g >>= 1
        return i

    def ones(i: int) -> int:
        """Trailing set bits."""
        return (~i & i + 1).bit_length() - 1

    place, state = [], []
    for entry in range(1 << n):
        for exit_ in range(n):
            for corner in range(1 << n):
                w = rank(turn(corner ^ entry, exit_ + 1))
                start = gray(2 * ((w - 1) // 2)) if w else 0
                along = 0 if not w else ones(w) % n if w % 2 else ones(w - 1) % n
                place.append(w)
                state.append((entry ^ turn(start, n - exit_ - 1)) * n + (exit_ + along + 1) % n)
    return place, state


def hilbert_index(axes: list[Column], bits: int = STEPS_BITS) -> Column:
    """Place on the curve of the cell with these coordinates, each of `bits` bits."""
    n = len(axes)
    place, state = (F.array(*map(F.lit, x)) for x in curve_tables(n))

    def step(at: Column, bit: Column) -> Column:
        corner = sum((F.getbit(a.cast("long"), bit).cast("int") * (1 << k) for k, a in enumerate(axes)), F.lit(0))
        entry = at["state"] * (1 << n) + corner
        return F.struct((at["index"] * (1 << n) + F.get(place, entry)).alias("index"), F.get(state, entry).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda x: x["index"])


def value_steps(rows: DataFrame, column: str) -> DataFrame:
    """(value, step) of a column's values: step is the share of rows before it, in 64ths."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select("value", "n", F.col("value").isNull().alias("last"))
    counts = running_sums(counts, ["last", "value"], {"before": "n"}, f"shard-{column}-counts")
    return counts.select("value", F.floor(F.col("before") * (1 << STEPS_BITS) / F.col("all_before")).cast("int").alias("step"))


def ranked(docs: DataFrame, carry: Column | None) -> DataFrame:
    """The rows with the column `carry` as row, id, size, crc, hilbert and their global rank, in the order
    of the curve."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(crc32_of(F.col("text")), F.lit(0)).cast("long")
    rows = docs.select(*([] if carry is None else [carry.alias("row")]), F.col("doc_id").alias("id"), "lang", "source", size.alias("size"), crc.alias("crc"))
    for column in ("lang", "source"):
        steps = written(value_steps(docs, column), f"shard-{column}").select(F.col("value").alias(f"{column}_value"), F.col("step").alias(f"{column}_step"))
        rows = rows.join(steps, F.col(column).eqNullSafe(F.col(f"{column}_value")), "left")
    length = F.least(F.floor(F.log2(F.col("size")) * 2), F.lit((1 << STEPS_BITS) - 1)).cast("int")
    rows = rows.withColumn("hilbert", hilbert_index([F.col("lang_step"), F.col("source_step"), length]))
    rows = rows.drop("lang", "source", "lang_value", "source_value", "lang_step", "source_step")
    parts = rows_per_task(docs.sparkSession, docs.count(), 250_000)
    key = ["hilbert", "crc", "id", "size"]
    rows = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    rows = written(rows, "shard-rows")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.partitionBy().orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy()).alias("all"))
    # One row for each partition that this function asked for.
    return rows.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("place"))


def shard(docs: DataFrame, shards: int = 8, carry: Column | None = None) -> DataFrame:
    """The column `carry` as row, if there is one, and doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert."""
    rows = ranked(docs, carry)
    rows = rows.withColumn("shard", F.expr(f"cast(rank * {shards} div all as int)"))
    start = F.expr(f"(shard * all + {shards - 1}) div {shards}")
    own = [] if carry is None else ["row"]
    return rows.select(
        *own, F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def with_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The documents with their columns, and two more: shard and slot (named shard_1, ... where the
    documents have such a column, in any case of letters)."""
    names = [free_name(name, docs.columns) for name in ("shard", "slot")]
    rows = shard(docs, shards, whole_row(docs))
    return rows.select("row.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))
