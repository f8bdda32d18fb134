"""Connected components and approximate membership, without gathering ids on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Bits of the membership filter: 4 MB on the driver and each executor, whatever the input.
FILTER_BITS = 1 << 25
ROWS_PER_FILE = 500_000


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in edges(a, b).

    Each round takes the smallest label among a node's neighbours, then the label of its label, so
    paths halve. A hub's edges meet its label in a join that adaptive execution can split, and the
    minimum is combined before the shuffle. Every round is a table in the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), name)
    parts = 1 + both.count() // ROWS_PER_FILE
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), name, parts)
    while True:
        near = both.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("next"))
        step = written(step.join(jump, "to").select("id", F.least("to", "next").alias("component"), "was"), name, parts)
        forget(labels)
        labels = step
        if not step.filter("component < was").take(1):
            forget(both)
            out = step.select("id", "component")
            out.scratch_path = step.scratch_path
            return out


def slot_of(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(FILTER_BITS - 1)


def membership(ids: DataFrame, column: str, hashed: bool = False) -> np.ndarray:
    """A bit for slot_of each id, or for the id itself if it is `hashed` already; a clear bit means
    the id is not there. At most FILTER_BITS / 64 rows reach the driver."""
    slot = F.col(column).bitwiseAND(FILTER_BITS - 1) if hashed else slot_of(F.col(column))
    rows = ids.select(slot.alias("slot")).select(F.shiftright("slot", 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    words = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1
