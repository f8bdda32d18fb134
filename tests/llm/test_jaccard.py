import random

import numpy as np
import pytest

from wavemark.llm.graph import components
from wavemark.llm import jaccard
from wavemark.llm.jaccard import JaccardConfig, join, keep_one, shingles

SCHEMA = "doc_id long, text string"


def brute(rows, cfg):
    """Component of each row by comparing all pairs and searching the graph."""
    sets = [set(zip(*[(t or "").encode().lower().split()[k:] for k in range(cfg.width)], strict=False)) or ({tuple((t or "").encode().lower().split())} if (t or "").split() else set()) for _, t in rows]
    near = {i: [] for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if cfg.scale * both >= cfg.least * (len(sets[i]) + len(sets[j]) - both):
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i in range(len(rows)):
        seen, stack = {i}, [i]
        while stack:
            for k in near[stack.pop()]:
                if k not in seen:
                    seen.add(k)
                    stack.append(k)
        out.append((rows[i][0], len(sets[i]), min(rows[k][0] for k in seen) if rows[i][0] is not None else None))
    return sorted(out, key=str)


def families(seed, groups=6, members=14, words=60, edits=5):
    """Near copies around the threshold, chained edits, and bystanders that share a passage."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(200)}" for _ in range(words)]
        for m in range(members):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                k = rng.randrange(len(text))
                text[k : k + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(3)
            if rng.random() < 0.2:
                base = text
            out.append(" ".join(text))
    shared = " ".join(f"common{i}" for i in range(30))
    out += [f"{shared} " + " ".join(f"own{i}x{k}" for k in range(rng.randrange(2, 30))) for i in range(15)]
    out += [out[0], out[1], out[1].upper()]
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("cfg", [JaccardConfig(4, 85), JaccardConfig(5, 80), JaccardConfig(2, 60)], ids=str)
def test_equals_brute_force(spark, seed, cfg):
    rows = families(seed)
    got = [tuple(r) for r in join(spark.createDataFrame(rows, SCHEMA), cfg).collect()]
    assert sorted(got, key=str) == brute(rows, cfg)


@pytest.mark.parametrize("cfg", [JaccardConfig(4, 85, hot=3), JaccardConfig(4, 85, hot=2, family_block=5, shard_bytes=2000)], ids=str)
def test_split_lists_and_families_lose_nothing(spark, cfg):
    rows = families(9, groups=3, members=40)
    got = [tuple(r) for r in join(spark.createDataFrame(rows, SCHEMA), cfg).collect()]
    assert sorted(got, key=str) == brute(rows, cfg)


def test_corpus_and_edges(docs, corpus, empty, odd_columns):
    cfg = JaccardConfig(4, 85)
    got = [tuple(r) for r in join(docs, cfg).collect()]
    assert sorted(got, key=str) == brute([(r[0], r[1]) for r in corpus], cfg)
    assert join(empty, cfg).count() == 0 == keep_one(empty, cfg).count()
    out = keep_one(odd_columns, cfg)
    assert out.columns == odd_columns.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    first = {}
    for (doc_id, text, *_), (_, n, component) in zip(sorted(corpus, key=str), sorted(brute_rows(corpus, cfg), key=str), strict=True):
        if doc_id is not None and n:
            first[component] = min(first.get(component, (doc_id, text)), (doc_id, text))
    blank = [(r[0], r[1]) for r in corpus if r[0] is None or not (r[1] or "").encode().split()]
    assert len([k for k in kept if k[0] is None]) == 1
    assert {k for k in kept if k[0] is not None and (k[1] or "").encode().split()} >= {v for k, v in first.items() if v[0] not in (10, 20)}
    assert {k for k in kept if k in blank} == set(blank)
    assert len(kept) == len(set(kept))


def brute_rows(corpus, cfg):
    """(row without its text, n, component) in the order of the rows' words."""
    rows = sorted(corpus, key=str)
    named = brute([(r[0], r[1]) for r in rows], cfg)
    lookup = {}
    for doc_id, n, component in named:
        lookup.setdefault(doc_id, []).append((n, component))
    out = []
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        n = max(min(1, len(words)), len({tuple(words[i : i + cfg.width]) for i in range(len(words) - cfg.width + 1)}))
        out.append((str(r), n, next(c for k, c in lookup[r[0]] if k == n)))
    return out


def test_repeated_ids_lose_no_text(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, one, "p"), (2, one, "q"), (2, two, "r"), (2, two, "s"), (2, two, "s"), (7, three, "t"), (7, one, "u"), (7, None, "v"), (7, None, "v"), (None, one, "w")]
    for order in (rows, rows[::-1]):
        got = [tuple(r) for r in keep_one(spark.createDataFrame(order, "doc_id long, text string, Group string").repartition(3)).collect()]
        assert len(got) == 6 and {x[:2] for x in got} == {(1, one), (2, two), (7, three), (7, None), (None, one)}
        assert len({x[2] for x in got if x[0] == 2}) == 1
    names = join(spark.createDataFrame([(3, one), (3, two)], SCHEMA)).collect()
    assert [(r.doc_id, r.component_id) for r in names] == [(3, 3), (3, 3)]


def test_large_family_costs_its_size(spark, monkeypatch):
    """Near copies of one text, many of them not near the hub: 20,000 sets in cells of 500."""
    rng = random.Random(2)
    base, n = [f"w{i}" for i in range(200)], 20_000
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(1, 5)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**7)}"
        rows.append((i, " ".join(text)))
    rows += [(n + i, " ".join([*base[:150], *(f"far{i}x{k}" for k in range(50))])) for i in range(20)]
    rows += [(n + 20 + i, " ".join([*base[:150], *(f"near{k}" for k in range(49)), f"own{i}"])) for i in range(20)]
    rng.shuffle(rows)
    seen = []
    cells, strays = jaccard.family_cells, jaccard.family_strays
    monkeypatch.setattr(jaccard, "family_cells", lambda rows, *x: seen.append(rows.count()) or cells(rows, *x))
    monkeypatch.setattr(jaccard, "family_strays", lambda rows, *x: seen.append(rows.count()) or strays(rows, *x))
    cfg = JaccardConfig(4, 80, family_block=500)
    got = {r.doc_id: r.component_id for r in join(spark.createDataFrame(rows, SCHEMA).repartition(4), cfg).collect()}
    assert sum(seen) < 10 * n and len(seen) > 1
    assert {got[i] for i in range(n)} == {0}
    assert [got[n + 20 + i] for i in range(20)] == [n + 20] * 20
    assert [got[n + i] for i in range(20)] == [n + i for i in range(20)]


@pytest.mark.parametrize("seed", range(2))
def test_strays_of_large_families(spark, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(220):
        text = list(base)
        for _ in range(rng.randrange(7)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**7)}"
        rows.append((i, " ".join(text)))
    cfg = JaccardConfig(4, 70, family_block=20)
    got = [tuple(r) for r in join(spark.createDataFrame(rows, SCHEMA), cfg).collect()]
    assert sorted(got, key=str) == brute(rows, cfg)


def test_families_cut_by_bytes_alone_lose_nothing(spark):
    """Families below the block whose differences are many bytes, and some that end at other levels."""
    rng = random.Random(1)
    rows = []
    for g, members in enumerate((40, 120)):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randrange(7)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**7)}"
            rows.append((len(rows), " ".join(text)))
    cfg = JaccardConfig(4, 70, family_bytes=2_000)
    got = [tuple(r) for r in join(spark.createDataFrame(rows, SCHEMA), cfg).collect()]
    assert sorted(got, key=str) == brute(rows, cfg)


def test_crowds_of_several_families_cost_their_size(spark, monkeypatch):
    """Sets of two sizes share a rare block, so that whichever set is its hub, half of them have none;
    few of their pairs link."""
    rng = random.Random(4)
    rare = [f"r{i}" for i in range(30)]
    pool = [[f"p{b}x{i}" for i in range(60)] for b in range(30)]
    texts = [[w for block in pool for w in block]] * 1_000
    for i in range(600):
        text = [*rare, *(w for block in rng.sample(pool, 2 + i % 2) for w in block)]
        texts.append(text)
        if i % 10 < 2:
            near = list(text)
            near[rng.randrange(40, len(near))] = f"e{i}"
            texts.append(near)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    made = []
    written = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name, *x: [out := written(df, name, *x), made.append((out.count(), name))][0])
    cfg = JaccardConfig(4, 85)
    got = sorted((tuple(r) for r in join(spark.createDataFrame(rows, SCHEMA).repartition(4), cfg).collect()), key=str)
    own = [r for r in rows if len(r[1].split()) < 1_000]
    own.append(next(r for r in rows if len(r[1].split()) > 1_000))
    small = {r[0]: r for r in brute(own, cfg)}
    assert [r for r in got if r[0] in small] == sorted(small.values(), key=str)
    assert len({r[2] for r in got}) > 100 and max(made)[0] < 20 * len(rows)


@pytest.mark.parametrize("cfg", [JaccardConfig(4, 85, crowd=0), JaccardConfig(4, 85, hot=3, crowd=0, family_block=5, family_bytes=1_000)], ids=str)
def test_crowds_lose_nothing(spark, cfg):
    rows = families(9, groups=3, members=40)
    got = [tuple(r) for r in join(spark.createDataFrame(rows, SCHEMA), cfg).collect()]
    assert sorted(got, key=str) == brute(rows, cfg)


def test_shingles():
    assert len(shingles(b"a b c", 5)) == 1 and len(shingles(None, 5)) == len(shingles(b" \n", 5)) == 0
    assert np.array_equal(shingles(b"A b C d e", 4), shingles(b"a B c d E", 4))
    assert len(shingles("a\x1cb c d e".encode(), 4)) == 1


def test_prefix_and_bounds_hold():
    cfg = JaccardConfig(4, 85)
    for n in range(1, 60):
        for m in range(1, 60):
            need = next((i for i in range(min(n, m) + 1) if 100 * i >= 85 * (n + m - i)), None)
            if need is not None:
                assert cfg.overlap(n, m) == need
                assert min(cfg.prefix(n) - (n - need), cfg.prefix(m) - (m - need)) >= int(cfg.shared_of(np.int64(n), np.int64(m))) >= 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
