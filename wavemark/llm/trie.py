"""Operator 12: a trie of conversation prefixes, held as preorder intervals.

A node is a distinct sequence of first turns (role, text). Conversations that share it are its members;
one model pass over a node's last turn serves them all, and what that saves is its words times its
members but one. Sums over subtrees come from preorder numbers: nodes are ranked so that a subtree is
one run, each stores the run's end, and leaves and savings are differences of prefix sums.

A turn becomes a digest of role and text when it is read; texts go no further. A node's key is made of
sums, over its turns, of hashes of digest and place, so keys are prefix sums too, and a conversation
of any length is spread over tasks: rows are ranged by conversation and place, summed inside each
range, and what stands in the ranges before is added (`running`).

Nodes with the same members form a chain: a node with (smallest member, number of members) is on just
one, as the members of nodes on one path only get fewer. Chains are few, since each ends where members
part or end, and only they are ranked. A chain's path lists the chains above it and is made by
pointer doubling; paths sort in lexicographic order of smallest members, a chain before those below it.
With N turns a path is shorter than sqrt(2 N), as each chain above has lost a member that had all its
turns, and all paths together are no longer than the conversations. Nodes take their numbers and
sums from their chain, joined by chain and block of `BLOCK` depths, so a long chain is split.

Members that end at a node are joined in order of id and hashed. Ids are packed 256 values wide in
groups of their own before that, and one task reads the pieces of a node as a stream: SHA-256 has to
see its bytes one after another, but holds none of them.

Cases: a null role or text is an empty one; turns sort by number, null first, then by their digest,
and turns that are equal in all count each; a null conv_id belongs to no conversation; texts of any
length are one digest; an empty table has no nodes, not even a root; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, rows_per_task, word_count, written

#: Rows a task when rows are ranged, and depths of a chain in one group.
ROWS, BLOCK = 500_000, 65_536
#: Bits of a conv_id inside a piece of a node's list of ends.
PIECE_BITS = 8
LANES = [f"lane_{i}" for i in range(4)]
CHAIN = ["conv_id", "n_convs"]


def ranged(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows dealt by ranges of the keys, with their range as part."""
    source = written(rows, f"{name}-rows")
    parts = rows_per_task(rows.sparkSession, source.count(), ROWS)
    out = written(source.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), name)
    forget(source)
    return out


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds sums over the rows of a group up to each row, for rows of `ranged` by group and order. A
    group may span many ranges: those that do are two a range at most, and are broadcast."""
    spans = rows.groupBy("part", *group).agg(*[F.sum(c).alias(f"all_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("part", *group, *[F.sum(f"all_{n}").over(before).alias(f"before_{n}") for n in sums]).dropna()
    inside = Window.partitionBy("part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n, c in sums.items():
        rows = rows.withColumn(n, F.sum(c).over(inside))
    rows = rows.join(F.broadcast(spans), ["part", *group], "left")
    return rows.select(*[c for c in rows.columns if c not in sums and not c.startswith("before_")], *[(F.col(n) + F.coalesce(f"before_{n}", F.lit(0))).alias(n) for n in sums])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, digest, words): the turns of each conversation in order, from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), word_count(text).alias("words"), F.monotonically_increasing_id().alias("row"))
    order = ["turn", "digest", "row"]
    rows = ranged(rows, ["conv", *order], "trie-turns")
    out = written(running(rows, ["conv"], order, {"pos": F.lit(1).cast("long")}).select("conv", "pos", "digest", "words"), "trie-placed")
    forget(rows)
    return out


def with_shared_heads(placed: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the heads of others: the first h turns of conversation c - c % every, then
    c's own after its first h, with h = crc32(c) % most. Gives (conv, depth, digest, words) and (conv)."""
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("long")
    firsts = placed.filter((F.col("pos") < most) & (F.col("conv") % every == 0)).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"))
    convs = placed.select("conv").distinct().withColumn("base", F.col("conv") - F.col("conv") % every)
    convs = convs.join(firsts.withColumnRenamed("conv", "base"), "base", "left")
    convs = convs.select("conv", F.filter("turns", lambda t: t["pos"] <= head).alias("turns"))
    convs = written(convs.select("conv", "turns", (head - F.coalesce(F.size("turns"), F.lit(0))).alias("short")).withColumn("short", F.when(F.col("turns").isNull(), head).otherwise(F.col("short"))), "trie-heads")
    taken = convs.select("conv", F.explode("turns").alias("t")).select("conv", F.col("t.pos").alias("depth"), "t.digest", "t.words")
    # A conversation's turns may be many: adaptive execution splits them, the other side is unique.
    own = placed.filter(F.col("pos") > head).join(convs.filter("short > 0").select("conv", "short"), "conv", "left")
    own = own.select("conv", (F.col("pos") - F.coalesce("short", F.lit(0))).alias("depth"), "digest", "words")
    return taken.unionByName(own), convs.select("conv")


def node_key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[x.cast("string") for x in lanes])))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv): ids ascending, joined by commas."""
    pieces = ends.groupBy("node", F.shiftright("conv", PIECE_BITS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0), batch.column(1), strict=True):
                if sha is None or node.as_py() != held:
                    if sha is not None:
                        done.append((held, sha.hexdigest()))
                    held, sha = node.as_py(), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["node", "ends_sha256"])

    return pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def nodes_and_ends(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, parent, depth, words, conv_id, n_convs) of every node, and (node, conv) of every
    conversation's last."""
    rows = ranged(rows, ["conv", "depth"], "trie-ranged")
    low = F.lit((1 << 32) - 1)
    hashes = [F.xxhash64(F.lit(i), "depth", "digest") for i in range(2)]
    for i, h in enumerate(hashes):
        rows = rows.withColumn(f"own_{2 * i}", h.bitwiseAND(low)).withColumn(f"own_{2 * i + 1}", F.shiftrightunsigned(h, 32))
    own = [F.col(f"own_{i}") for i in range(4)]
    keyed = running(rows, ["conv"], ["depth"], dict(zip(LANES, own, strict=True)))
    lanes = [F.col(x) for x in LANES]
    keyed = keyed.select("conv", "depth", "words", node_key(F.col("depth"), lanes).alias("node"), node_key(F.col("depth") - 1, [a - b for a, b in zip(lanes, own, strict=True)]).alias("parent"))
    keyed = written(keyed, "trie-keyed")
    zero = F.lit(0).cast("long")
    nodes = keyed.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(node_key(zero, [zero] * 4).alias("node"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), zero.alias("words"), "conv_id", "n_convs")
    last = keyed.groupBy("conv").agg(F.max(F.struct("depth", "node")).alias("last"))
    ends = convs.join(last, "conv", "left").select(F.coalesce("last.node", node_key(zero, [zero] * 4)).alias("node"), "conv")
    return written(nodes.unionByName(root), "trie-nodes"), ends


def chain_paths(nodes: DataFrame) -> DataFrame:
    """The chains: CHAIN, top, bottom, node (of the bottom), saved, n_children (of the bottom), and path,
    the CHAIN of each chain from the root's to its own."""
    saved = (F.col("n_convs") - 1) * F.col("words")
    chains = nodes.groupBy(*CHAIN).agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum(saved).alias("saved"), F.min(F.struct("depth", "parent")).alias("first"), F.max(F.struct("depth", "node")).alias("last"))
    chains = written(chains.select(*CHAIN, "top", "bottom", "saved", F.col("first.parent").alias("parent"), F.col("last.node").alias("node")), "trie-chains")
    above = chains.select(F.col("node").alias("parent"), F.struct(*CHAIN).alias("up"))
    linked = written(chains.join(above, "parent", "left").drop("parent"), "trie-linked")
    below = linked.filter("up is not null").groupBy("up").agg(F.count("*").alias("n_children"))
    linked = linked.join(below.select("up.*", "n_children"), CHAIN, "left").fillna(0, ["n_children"])
    paths = written(linked.withColumn("path", F.array(F.struct(*CHAIN))), "trie-paths")
    while paths.filter("up is not null").take(1):
        # Many chains may stand below one: they are the side that adaptive execution splits.
        higher = paths.select(F.struct(*CHAIN).alias("up"), F.col("path").alias("higher"), F.col("up").alias("next"))
        step = paths.join(higher, "up", "left").withColumn("path", F.concat(F.coalesce("higher", F.array().cast(paths.schema["path"].dataType)), "path"))
        step = written(step.select(*[c if c != "up" else F.col("next").alias("up") for c in paths.columns]), "trie-paths")
        forget(paths)
        paths = step
    forget(chains)
    return paths.drop("up")


def chain_intervals(chains: DataFrame) -> DataFrame:
    """Adds to the chains: start, the preorder number of the top; end, that of the last node below it;
    n_leaves and below, the leaves and savings in the chains of its subtree but its own savings."""
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    chains = ranged(chains.withColumn("all", F.lit(0)), ["path"], "trie-ordered")
    sums = {"rank": F.lit(1).cast("long"), "nodes_upto": F.col("bottom") - F.col("top") + 1, "leaves_upto": leaf, "saved_upto": F.col("saved")}
    ranks = written(running(chains, ["all"], ["path"], sums), "trie-ranks")
    ends = ranks.filter("n_children = 0").select(F.explode("path").alias("chain"), "rank").groupBy("chain").agg(F.max("rank").alias("end_rank")).select("chain.*", "end_rank")
    last = ranks.select(F.col("rank").alias("end_rank"), (F.col("nodes_upto") - 1).alias("end"), F.col("leaves_upto").alias("leaves_end"), F.col("saved_upto").alias("saved_end"))
    rows = ranks.join(ends, CHAIN).join(last, "end_rank")
    above = F.when(F.size("path") > 1, F.element_at("path", -2)["conv_id"])
    return rows.select(
        *CHAIN, "top", "bottom", "node", "saved", "n_children", above.alias("above"), (F.col("nodes_upto") - (F.col("bottom") - F.col("top") + 1)).alias("start"), "end",
        (F.col("leaves_end") - F.col("leaves_upto") + leaf).alias("n_leaves"), (F.col("saved_end") - F.col("saved_upto")).alias("below"),
    )


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations (conv) with turns (conv, depth, digest, words), depth from 1 without
    gaps: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    the interval of the subtree, preorder and subtree_end."""
    nodes, ends = nodes_and_ends(rows, convs)
    chains = chain_intervals(chain_paths(nodes)).join(ends_digests(ends), "node", "left").drop("node")
    own = (F.col("n_convs") - 1) * F.col("words")
    split = nodes.withColumn("block", F.floor(F.col("depth") / BLOCK)).withColumn("own", own)
    blocks = split.groupBy(*CHAIN, "block").agg(F.sum("own").alias("in_block"))
    earlier = F.sum("in_block").over(Window.partitionBy(*CHAIN).orderBy("block")) - F.col("in_block")
    blocks = written(blocks.withColumn("earlier", earlier).drop("in_block").join(chains, CHAIN), "trie-blocks")
    upto = F.sum("own").over(Window.partitionBy(*CHAIN, "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")
    rows = split.withColumn("before", upto).join(blocks, [*CHAIN, "block"])
    bottom = F.col("depth") == F.col("bottom")
    return rows.select(
        "conv_id", "depth", F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("top"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(bottom, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("below") + F.col("saved") - F.col("earlier") - F.col("before")).alias("saved_tokens"),
        F.when(bottom & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(hashlib.sha256(b"").hexdigest()).alias("ends_sha256"),
        (F.col("start") + F.col("depth") - F.col("top")).alias("preorder"), F.col("end").alias("subtree_end"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    placed = turns(conversations)
    return trie(placed.withColumnRenamed("pos", "depth"), placed.select("conv").distinct())


def rebuilt_trie(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The trie of conversations rebuilt on each other's heads."""
    return trie(*with_shared_heads(turns(conversations), every, most))


SQL = r"""
WITH t0 AS (
    SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS w FROM conversations WHERE conv_id IS NOT NULL
), t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos FROM t0),
c AS (
    SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)
), b AS (
    SELECT c.conv_id, pos, g, w FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
    UNION ALL SELECT c.conv_id, pos, g, w FROM c JOIN t USING (conv_id) WHERE pos > h
), l AS (SELECT conv_id, list(g ORDER BY pos) AS gs, list(w ORDER BY pos) AS ws FROM b GROUP BY conv_id),
f AS (SELECT conv_id, coalesce(gs, []::VARCHAR[]) AS gs, coalesce(ws, []::BIGINT[]) AS ws FROM c LEFT JOIN l USING (conv_id)),
m AS (SELECT conv_id, gs, ws, unnest(range(0, len(gs) + 1)) AS d FROM f),
n AS (
    SELECT gs[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(ws[d]), 0) AS w,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(gs) = d), '')) AS ends_sha256
    FROM m GROUP BY gs[1:d], d
), ch AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
n2 AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k, d)),
up AS (SELECT k[1:i] AS k, i AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM n2) GROUP BY k[1:i], i)
SELECT n2.conv_id, n2.d AS depth, p.conv_id AS parent_conv_id, n2.n_convs, n2.n_children, CAST(up.n_leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, n2.ends_sha256
FROM n2 JOIN up ON up.k = n2.k AND up.d = n2.d LEFT JOIN n p ON n2.d > 0 AND p.d = n2.d - 1 AND p.k = n2.k[1:n2.d - 1]
"""
