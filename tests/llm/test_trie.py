import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from comparing import rows_of
from pyspark.sql import functions as F

from wavemark.llm import trie
from wavemark.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def in_order(rows):
    """Turns of each conversation; equal numbers sort by digest."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            held[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    return {c: [x[3] for x in sorted(v)] for c, v in held.items()}


def rebuilt(convs, every=20, most=4):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    """Every node by its whole sequence; a subtree is the nodes that start with it."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, out = defaultdict(int), []
    for node in members:
        if node:
            kids[node[:-1]] += 1
    own = {n: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0) for n, m in members.items()}
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += own[n]
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(nodes):
    return sorted((tuple(r[f] for f in FIELDS) for r in nodes.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd():
    """Shared heads, copies, a long conversation and prefixes of it, nulls, ties, negative ids."""
    rng, rows = random.Random(3), []
    words = ["a", "b c", "d\x1ce f", "", "g " * 30]
    for c in [*range(0, 47), 100, 119, -3, -20, -27, 1 << 40]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for t in range(rng.randint(1, 5))]
    for c in range(200, 212):
        rows += [(c, t, "user", f"same {t}") for t in range(4)]
    for c, n in ((220, 60), (221, 60), (222, 31), (223, 58)):
        rows += [(c, t, "user", f"long {t // 2}") for t in range(n)]
    rows += [(300, None, "user", "first"), (300, 5, "user", "tie b"), (300, 5, "user", "tie a"), (300, 5, None, None), (300, 5, "user", "tie a")]
    rows += [(None, 0, "user", "no conversation"), (301, 0, "us", "er"), (321, 0, "u", "ser"), (302, 1, "user", "long text " * 20_000)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, odd):
    assert got(trie.rebuilt_trie(table(spark, odd))) == brute(rebuilt(in_order(odd)))


def test_groups_that_span_many_tasks(spark, odd, monkeypatch):
    monkeypatch.setattr(trie, "ROWS", 9)
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "PIECE_BITS", 1)
    assert got(trie.rebuilt_trie(table(spark, odd))) == brute(rebuilt(in_order(odd)))


def test_intervals_are_preorder(spark, odd):
    rows = sorted(trie.prefix_trie(table(spark, odd)).collect(), key=lambda r: r.preorder)
    assert got(trie.prefix_trie(table(spark, odd))) == brute(in_order(odd))
    assert [r.preorder for r in rows] == list(range(len(rows)))
    stack = []
    for r in rows:
        while stack and stack[-1].depth >= r.depth:
            stack.pop()
        assert (stack[-1].conv_id if stack else None) == r.parent_conv_id
        assert all(r.subtree_end <= s.subtree_end for s in stack)
        stack.append(r)
    for r in rows:
        inside = [x for x in rows[r.preorder + 1 :] if x.depth <= r.depth]
        assert r.subtree_end == (inside[0].preorder - 1 if inside else len(rows) - 1)


def test_conversations_without_turns_end_at_the_root(spark):
    # crc32("27") % 4 and others leave a conversation of one turn with none where its base is absent.
    convs = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4][:3]
    rows = [(c, 0, "user", "only") for c in convs]
    (root,) = trie.rebuilt_trie(table(spark, rows)).collect()
    assert (root.conv_id, root.depth, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (convs[0], 0, None, 3, 0, 1, 0)
    assert root.ends_sha256 == hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()


def test_many_ends_at_one_node(spark):
    ids = [*range(-700, 3000, 3), 1 << 50]
    rows = [(c, 0, "user", "hello there") for c in ids]
    nodes = {r.depth: r for r in trie.prefix_trie(table(spark, rows)).collect()}
    assert nodes[1].ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert (nodes[1].n_convs, nodes[0].saved_tokens) == (len(ids), 2 * (len(ids) - 1))


def test_query_equals_sql(spark, duck, data):
    rows = op12_prefix_trie(spark, data)
    assert rows.columns == list(FIELDS)
    expected = duck.execute(trie.SQL).df()
    assert rows_of(rows.toPandas()) == rows_of(expected.astype(object).where(expected.notna(), None))


def test_empty_and_clashing_columns(spark, odd):
    assert trie.rebuilt_trie(table(spark, odd).limit(0)).count() == 0
    assert trie.rebuilt_trie(table(spark, [(None, 0, "user", "x")])).count() == 0
    rows = [r for r in odd if r[0] is not None and r[0] < 25]
    named = table(spark, rows)
    for name in ("conv", "Pos", "row", "digest", "depth", "node", "words", "part", "a`b", "c.d"):
        named = named.withColumn(name, F.lit("own"))
    assert got(trie.rebuilt_trie(named)) == brute(rebuilt(in_order(rows)))
