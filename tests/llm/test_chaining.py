import random
import resource
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemark.llm import chaining
from wavemark.llm.chaining import EDGE, ChainingConfig, aligned, alike, chains_of, common_words, extend, given_back, long_windows, minimisers, passages, repeated_passages, strays, word_hashes, words_of

CFG = ChainingConfig()


def best_chain(points, cfg):
    """The best score by trying every earlier match."""
    score = []
    for i, (x, y) in enumerate(points):
        gains = [score[j] - cfg.skip * (x - u + y - v) for j, (u, v) in enumerate(points[:i]) if u < x and v < y]
        score.append(cfg.k + max([0, *gains]))
    return max(score)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25, unique=True))
def test_fenwick_chain_is_optimal(points):
    points = sorted(points)
    chains = chains_of([p[0] for p in points], [p[1] for p in points], CFG)
    assert sorted(i for c in chains for i in c) == list(range(len(points)))
    for c in chains:
        steps = [points[i] for i in c]
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(steps, steps[1:], strict=False))
    first = [points[i] for i in chains[0]]
    worth = CFG.k * len(first) - sum(CFG.skip * (b[0] - a[0] + b[1] - a[1]) for a, b in zip(first, first[1:], strict=False))
    assert worth == pytest.approx(best_chain(points, CFG))


def test_minimisers_are_shared():
    rng = random.Random(0)
    passage = [b"p%d" % rng.randrange(10**6) for _ in range(CFG.window + CFG.k - 1)]
    for _ in range(30):
        a, b = ([b"x%d" % rng.randrange(10**6) for _ in range(rng.randrange(30))] for _ in range(2))
        seeds = [set(minimisers(word_hashes([*x, *passage, *x[::-1]]), CFG)[0].tolist()) for x in (a, b)]
        assert seeds[0] & seeds[1]
    assert len(minimisers(word_hashes([b"a"] * 4), CFG)[0]) == 0 and len(minimisers(word_hashes([b"a"] * 5), CFG)[0]) == 1


def test_alignment_parts():
    a, b = (np.array(x, np.uint32) for x in ([1, 2, 3, 4, 5], [1, 9, 3, 5]))
    assert common_words(a, b) == 3 and common_words(a, a) == 5
    assert extend(np.array([1, 2, 3, 9]), np.array([1, 2, 3, 8])) == (3, 3)
    assert extend(np.array([1, 2, 3, 0, 5, 6, 7, 8]), np.array([1, 2, 3, 9, 5, 6, 7, 8])) == (8, 7)
    assert extend(np.array([]), np.array([1])) == (0, 0)
    x = np.arange(100, 130)
    assert aligned(x, x, np.array([3, 9, 10]), np.array([3, 9, 10]), 5) == (0, 30, 0, 30, 30)


def test_planted_passages(spark, docs, corpus):
    rows = repeated_passages(docs).collect()
    ids = {r[0]: i for i, r in enumerate(corpus)}
    holders = {r[0] for r in corpus[134:140]}
    found = {x for r in rows for x in (r.doc_id, r.other_doc_id)}
    assert holders <= found and {r[0] for r in corpus[120:128]} | {3} <= found
    clean = {r[0] for r in corpus[30:115]} - {20}
    assert not clean & found
    for r in rows:
        a, b = (corpus[ids[i]][1].lower().split() for i in (r.doc_id, r.other_doc_id)) if r.doc_id != 20 else ([], [])
        if a:
            assert 0 <= r.start < r.stop <= len(a) and 0 <= r.other_start < r.other_stop <= len(b)
            assert r.stop - r.start >= 50 and r.identity >= 0.8
    fuzzy = corpus[139][0]
    assert any(fuzzy in (r.doc_id, r.other_doc_id) and 0.9 < r.identity < 1 for r in rows)


def test_each_holder_of_a_shared_passage_is_linked(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(55))
    rows = [(i, " ".join(f"a{rng.randrange(10**6)}" for _ in range(30)) + f" {passage} " + " ".join(f"b{rng.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x for r in got for x in (r.doc_id, r.other_doc_id)} == set(range(60)) and len(got) < 3 * 60
    assert all(r.stop - r.start >= 55 for r in got)


def test_indels(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    other = base[:30] + ["extra"] + base[30:60] + base[62:90] + ["new", "words"] + base[92:]
    got = repeated_passages(spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0].identity > 0.93 and got[0].stop - got[0].start >= 118


def test_edges(spark, empty, odd_columns, docs):
    assert repeated_passages(empty).count() == 0
    assert repeated_passages(odd_columns).count() == repeated_passages(docs).count()
    same = "same text " * 40
    rows = [(5, same), (5, same), (7, same), (None, same), (9, None)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_doc_id, r.identity) for r in got} == {(7, 5, 1.0)}


def test_two_passages_far_apart_are_both_found(spark):
    rng = random.Random(8)
    one, two = ([f"p{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2))
    rows = [(i, " ".join([*one, *(f"a{rng.randrange(10**6)}" for _ in range(200)), *two])) for i in range(40)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start) for r in got} | {(r.other_doc_id, r.start) for r in got} == {(i, at) for i in range(40) for at in (0, 260)}
    assert all(r.stop - r.start == 60 and r.start == r.other_start and r.identity == 1 for r in got)


def test_cut_chain_keeps_unlike_words_inside_a_passage():
    a, b = np.arange(400), np.arange(400)
    b[75:85] += 1000
    b[110:300] += 1000
    b[305:] += 1000
    at = np.array([50, 60, 70, 85, 100, 105, 300])
    b[:50] += 1000
    assert passages(a, b, at, at, CFG) == [(50, 110, 50, 110, 50)]


def test_passage_of_common_parts(spark):
    rng = random.Random(9)
    one, two = (" ".join(f"p{rng.randrange(10**6)}" for _ in range(n)) for n in (25, 25))
    rows = [(i, " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(20)), *([one] if i < 310 else []), *([two] if i >= 300 else []), *(f"b{rng.randrange(10**6)}" for _ in range(20))])) for i in range(610)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x for r in got for x in (r.doc_id, r.other_doc_id)} == set(range(300, 310))
    assert all(r.stop - r.start == 50 and r.identity == 1 for r in got)


@pytest.mark.parametrize("changed", [(), (30, 61)])
def test_repeated_words_are_matched_across_texts(spark, changed):
    rng = random.Random(10)
    cycle = [f"c{rng.randrange(10**6)}" for _ in range(7)]
    rows = []
    for i in range(4):
        run = cycle * 13
        for at in changed:
            run[at] = f"x{i}"
        rows.append((i, " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(20 + i)), *run, *(f"b{rng.randrange(10**6)}" for _ in range(20))])))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x for r in got for x in (r.doc_id, r.other_doc_id)} == set(range(4))
    for i in range(4):
        spans = [(r.start, r.stop) if r.doc_id == i else (r.other_start, r.other_stop) for r in got if i in (r.doc_id, r.other_doc_id)]
        assert min(a for a, _ in spans) <= 20 + i and max(b for _, b in spans) >= 20 + i + 91


def brute(rows, cfg=CFG):
    """Documents of passages, from the chains of every two texts over all places of all shared seeds."""
    seeds, words = {}, {}
    for i, text in rows:
        words[i] = word_hashes(words_of(text.encode())).astype(np.uint32)
        for token, at in zip(*minimisers(word_hashes(words_of(text.encode())), cfg), strict=True):
            seeds.setdefault(int(token), []).append((i, int(at)))
    met = {}
    for places in seeds.values():
        for i, x in places:
            for j, y in places:
                if j < i:
                    met.setdefault((i, j), set()).add((x, y))
    out = set()
    for (i, j), points in met.items():
        points = sorted(points)
        x, y = (np.array(v) for v in zip(*points, strict=True))
        for chain in chains_of(x.tolist(), y.tolist(), cfg):
            if len(chain) > 1 and passages(words[i], words[j], x[chain], y[chain], cfg):
                out |= {i, j}
    return out


def interlopers(seed, slices):
    """Passages held by few texts, word for word or with words changed, and by many texts in part."""
    rng = random.Random(seed)
    own = lambda n: [f"o{rng.randrange(10**7)}" for _ in range(n)]
    rows = []
    for _ in range(12):
        passage = [f"p{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(rng.choice([2, 2, 3])):
            held = [w if rng.random() > rng.choice([0, 0.04, 0.08]) else own(1)[0] for w in passage]
            rows.append([*own(rng.randrange(5, 40)), *held, *own(rng.randrange(5, 40))])
        for _ in range(slices):
            a = rng.randrange(46)
            rows.append([*own(rng.randrange(5, 30)), *passage[a : a + rng.choice([14, 14, 20, 30])], *own(rng.randrange(5, 30))])
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("slices", "cfg"), [(6, CFG), (60, CFG), (60, ChainingConfig(flush=200))], ids=str)
def test_passages_among_interlopers(spark, slices, cfg):
    rows = interlopers(slices, slices)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cfg).collect()
    found, expected = {x for r in got for x in (r.doc_id, r.other_doc_id)}, brute(rows)
    assert len(expected) > 20 and len(found & expected) >= 0.9 * len(expected)
    assert found <= expected


def test_a_passage_among_slices_of_it(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*(f"o{rng.randrange(10**7)}" for _ in range(30)), *passage[a : a + 14], *(f"o{rng.randrange(10**7)}" for _ in range(30))])) for i in range(400) for a in [rng.randrange(47)]]
    rows += [(1000 + i, " ".join([f"x{i}a{k}" for k in range(20)] + passage + [f"x{i}b{k}" for k in range(20)])) for i in range(2)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert {frozenset((r.doc_id, r.other_doc_id)) for r in got} == {frozenset((1000, 1001))}
    assert all((r.start, r.stop) == (20, 80) for r in got)


def test_repeats_inside_one_text(spark):
    rng = random.Random(3)
    passage, rest = ([f"{c}{rng.randrange(10**6)}" for _ in range(n)] for c, n in (("p", 70), ("r", 300)))
    rows = [(1, " ".join([*rest[:100], *passage, *rest[100:200], *passage, *rest[200:]])), (2, " ".join(rest[::-1]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeated_passages(frame).collect()
    assert [(r.doc_id, r.other_doc_id, r.start, r.stop, r.other_start, r.other_stop) for r in got] == [(1, 1, 270, 340, 100, 170)]
    assert repeated_passages(frame, ChainingConfig(inside=False)).count() == 0


def test_window_hashes_tell_windows():
    h = np.random.default_rng(0).integers(0, 1 << 63, 40).astype(np.uint64)
    h[20:35] = h[3:18]
    got = long_windows(h, 10)
    assert len(got) == 31 and (got[20:26] == got[3:9]).all() and len(set(got.tolist())) == 25
    assert len(long_windows(h[:9], 10)) == 0


def test_ties_and_split_lists_change_nothing(spark):
    """Equal passages in many texts, dealt in small portions: all are reported, and reruns agree."""
    rng = random.Random(12)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, " ".join(f"a{rng.randrange(10**6)}" for _ in range(20)) + f" {passage} " + " ".join(f"b{rng.randrange(10**6)}" for _ in range(20))) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for cfg in (CFG, ChainingConfig(few=2, flush=60)):
        a, b = (sorted(map(tuple, repeated_passages(x, cfg).collect())) for x in (frame.repartition(4), frame.repartition(4)))
        assert {i for r in a for i in r[:2]} == set(range(120)) == {i for r in b for i in r[:2]}


@pytest.mark.parametrize("seed", [60, 1, 2])
def test_fuzzy_passages_of_common_parts_are_all_found(spark, seed):
    """Parts of each passage stand in 60 more texts, so all lists are long and few hubs hold enough:
    every text that comparing all pairs reports is reported."""
    rows = interlopers(seed, 60)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x for r in got for x in (r.doc_id, r.other_doc_id)} == brute(rows)


def test_two_groups_of_one_list_are_joined(spark):
    """Both ways to go on from a common phrase are held by many, and one text of each way goes on like
    no hub's: it is found with the one text that is like it."""
    rng = random.Random(14)
    own = lambda n: [f"o{rng.randrange(10**7)}" for _ in range(n)]
    phrase, rest = own(20), own(40)
    rows = [[*own(60), *phrase, *own(60)] for _ in range(40)]
    rows += [[*own(30), *phrase, *(w if i % 8 else f"x{n}{i}" for i, w in enumerate(rest)), *own(30)] for n in range(2)]
    rng.shuffle(rows)
    got = repeated_passages(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(2)).collect()
    alike_ones = {i for i, r in enumerate(rows) if rest[1] in r}
    assert {frozenset((r.doc_id, r.other_doc_id)) for r in got} == {frozenset(alike_ones)}


def test_strays_are_what_most_of_a_list_is_not_joined_to():
    edges = np.array([(7, k, k) for k in range(6)] + [(7, 1, 0), (7, 2, 9), (7, 1, 9), (7, 4, 3), (8, 1, 1), (8, 2, 2)], EDGE)
    assert strays(edges, 2).tolist() == [(7, 3), (7, 4), (7, 5)]
    assert strays(edges[-2:], 1).tolist() in ([(8, 1)], [(8, 2)]) and not len(strays(edges[:0], 2))


@pytest.mark.parametrize("block", [3, 1_000])
def test_rows_of_words_alike(block):
    words = np.random.default_rng(2).integers(0, 30, (240, 25)).astype(np.uint32)
    words[50:55] = words[10]
    stray = np.arange(240) % 7 == 3
    got = {(int(a), int(b)) for x in alike(words, np.arange(240), stray, 9, block) for a, b in zip(*x, strict=True)}
    bags = [Counter(x for x in row.tolist() if x) for row in words]
    assert got == {(a, b) for a in range(240) if stray[a] for b in range(240) if sum((bags[a] & bags[b]).values()) >= 9}


def test_tasks_give_freed_memory_back():
    """Arrays too small to be mapped one by one, freed below one that stays."""
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize()
    arrays = [np.ones(12_000) for _ in range(2_000)]
    last, full = arrays.pop(), resident()
    assert list(given_back(iter([1, 2]))) == [1, 2]
    del arrays
    list(given_back(iter([])))
    assert full - resident() > 100 << 20 and last.all()


def test_packed_matches_travel_in_small_cells_and_are_dealt_many_at_a_time():
    rng = np.random.default_rng(3)
    m = np.zeros(50_000, chaining.MATCH)
    m["a"], m["b"], m["x"], m["y"] = (rng.integers(0, n, len(m)) for n in (300, 300, 5_000, 5_000))
    sink = chaining.Sink(4)
    sink.add(chaining.MATCHES, m, 6)
    kind, shard, data = sink.columns()
    assert set(shard.to_pylist()) == {2}
    assert max(map(len, data.to_pylist())) <= chaining.CELL
    assert b"".join(data.to_pylist()) == m.tobytes()
    found = list(chaining.dealt(iter([pa.RecordBatch.from_arrays([kind, data], ["kind", "data"])]), 16))
    assert sum(b.num_rows for b in found) == 16
    parts = [np.frombuffer(x, chaining.MATCH) for b in found for x in b.column("data").to_pylist()]
    assert (np.sort(np.concatenate(parts)) == np.sort(m)).all()
    pairs = [set(zip(p["a"].tolist(), p["b"].tolist(), strict=True)) for p in parts]
    assert sum(map(len, pairs)) == len(set().union(*pairs))


def test_many_texts_are_hashed_and_seeded_as_one_by_one_and_fast():
    rng = random.Random(15)
    texts = [bytes(rng.choice(b"aBZz09 \t\n\x0b\x0c\r\xc3\x9f") if rng.random() < 0.3 else rng.randrange(256) for _ in range(rng.randrange(300))) for _ in range(500)]
    texts += [b"", b" ", b"A", b"a b " * 30, b"x" * 40 + b" Y" + b"z" * 17, b"one two three four five"]
    hashes, bounds = chaining.text_hashes(texts)
    assert len(bounds) == len(texts) + 1 and bounds[-1] == len(hashes)
    expected = []
    for key, text in enumerate(texts):
        own = word_hashes(words_of(text))
        assert (hashes[bounds[key] : bounds[key + 1]] == own).all() and bounds[key + 1] - bounds[key] == len(own)
        expected += [(int(token), key, int(at), 0) for token, at in zip(*minimisers(own, CFG), strict=True)]
    assert chaining.seeds_of_all(np.arange(len(texts)), hashes, bounds, CFG).tolist() == expected
    texts = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(100)).encode() for _ in range(2_000)]
    now = time.thread_time
    one = now()
    for text in texts:
        minimisers(word_hashes(words_of(text)), CFG)
    two = now()
    chaining.seeds_of_all(np.arange(len(texts)), *chaining.text_hashes(texts), CFG)
    assert now() - two < 0.7 * (two - one)


def test_strays_go_to_no_more_shards_than_there_are_partitions(spark, monkeypatch):
    """So the packed cells between them grow with the input, not with the square of the partitions."""
    made, write = [], chaining.written
    monkeypatch.setattr(chaining, "written", lambda df, name, parts=None: made.append((name, write(df, name, parts))) or made[-1][1])
    frame = spark.createDataFrame(interlopers(60, 60), "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        repeated_passages(frame.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    lone = dict(made)["chain-strays"].filter(f"kind = {chaining.STRAYS}").select("shard").collect()
    assert lone and max(r[0] for r in lone) < 16


def test_runs_of_one_word_make_few_pairs_that_reach_as_far():
    """A word said over and over makes some pairs a place, not one for each other place near it, and
    lists have the same shortest pairs and the same words around them as of all pairs."""
    rng = random.Random(16)
    words = [b"o%d" % rng.randrange(10**6) for _ in range(60)] + [b"the"] * 200 + [b"o%d" % rng.randrange(10**6) for _ in range(60)] + [b"and"] * 30
    hashes, bounds = chaining.text_hashes([b" ".join(words)])
    e = chaining.seeds_of_all(np.array([5]), hashes, bounds, CFG)
    known = np.array([rng.random() < 0.5 or i for i in np.isin(e["token"], e["token"][np.flatnonzero(e["token"][1:] == e["token"][:-1])])])
    got = chaining.pairs_of(e, known, CFG)
    every = []
    for i in range(len(e)):
        for j in range(i + 1, len(e)):
            gap = int(e["at"][j] - e["at"][i])
            if gap <= CFG.least_words - CFG.k and ((gap >= CFG.apart and (known[i] or known[j])) or (j == i + 1 and known[i] and known[j])):
                every.append((chaining.mix64(e["token"][i : i + 1] ^ chaining.mix64(e["token"][j : j + 1]))[0], 5, e["at"][i], gap, 0))
    every = np.array(sorted(every, key=lambda r: r[3]), chaining.PAIR)
    assert len(got) < 0.2 * len(every) and (chaining.Lists(got).e == chaining.Lists(every).e).all()
    bags = [{int(t): Counter(x["words"][x["token"] == t].ravel().tolist()) - Counter({0: 10**9}) for t in np.unique(x["token"])} for x in (chaining.bags_of(hashes, p, CFG) for p in (got, every))]
    assert bags[0] == bags[1]


def test_runs_of_one_word_too_short_for_a_passage_are_not_chained(spark, monkeypatch):
    """Texts that share a word said 40 to 48 times and nothing around it are strays of one list; what
    they share is as much as a passage must agree in, but no passage, so none of it leaves the task."""
    rows_of, write = {}, chaining.written

    def written(df, name, parts=None):
        out = write(df, name, parts)
        if name in ("chain-strays", "chain-met"):
            rows_of[name] = out.collect()
        return out

    monkeypatch.setattr(chaining, "written", written)
    rng = random.Random(17)
    own = lambda n: [f"o{rng.randrange(10**7)}" for _ in range(n)]
    rows = [(i, " ".join([*own(30), *["the"] * (40 + i % 9), *own(30)])) for i in range(60)]
    rows += [(60 + i, " ".join([*own(30), *rows[0][1].split()[20:90], *own(30)])) for i in range(2)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert {x for r in got for x in (r.doc_id, r.other_doc_id)} == {0, 60, 61}
    assert any(r.kind == chaining.STRAYS for r in rows_of["chain-strays"])
    assert sum(len(r.data) for r in rows_of["chain-met"]) < 100 * chaining.MATCH.itemsize


def test_dense_stretches_and_words_in_order():
    cfg = ChainingConfig(least_words=6, identity=0.75)
    rng = np.random.default_rng(5)
    size = rng.integers(1, 25, 400)
    held = (rng.random((400, 30)) < rng.choice([0.5, 0.7, 0.8], (400, 1))) & (np.arange(30) < size[:, None])
    cut = rng.integers(0, 4, 400)

    def brute_dense(row, n, cut):
        before, after = 6 * (cut & 1), 6 * (cut >> 1)
        row = [True] * before + row[:n].tolist() + [True] * after
        # A place has six words of the text on each side that is cut.
        first, last = 2 * before, before + n - after
        return any(row[i] and row[j - 1] and sum(row[i:j]) >= 0.75 * (j - i) and (i < last or not after) and (j > first or not before) for i in range(len(row)) for j in range(i + 6, len(row) + 1))

    expected = [brute_dense(*x) for x in zip(held, size.tolist(), cut.tolist(), strict=True)]
    assert chaining.dense(held, size, cut, cfg).tolist() == expected and 50 < sum(expected) < 350
    for _ in range(50):
        a, b = (rng.integers(0, 8, rng.integers(0, 40)) for _ in range(2))
        assert chaining.in_order(a.tolist(), b.tolist()) == common_words(a, b)


def test_words_around_places_keep_their_order():
    """Places whose words overlap are one stretch, those far apart are two, and rows go on where the last
    ended."""
    hashes = np.arange(1, 1001, dtype=np.uint64)
    e = np.array([(7, 3, at, 10, 0) for at in (10, 60, 160, 600)] + [(9, 3, 985, 10, 0)], chaining.PAIR)
    got = chaining.bags_of(hashes, e, CFG)
    assert got[["token", "lo", "at", "cut"]].tolist() == [(7, 0, 0, 2), (7, 0, 150, 2), (7, 550, 550, 3), (9, 935, 935, 1)]
    assert [[x for x in w.tolist() if x] for w in got["words"]] == [[*range(1, 151)], [*range(151, 226)], [*range(551, 666)], [*range(936, 1001)]]
