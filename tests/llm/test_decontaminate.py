import math
import pickle
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemark.llm.decontaminate import DecontaminationConfig, Index, contaminated, item_parts, keep_clean, ngrams, passes, split_item, terms, unpacked

SCHEMA = "item_id long, text string"


def items(n, rng, vocabulary=60):
    return [(i, " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(5, 20))), f"answer{i} w{rng.randrange(vocabulary)}") for i in range(n)]


def brute_scores(index, passage):
    """Every item's score, term by term."""
    score = {}
    for t in passage & index.terms.keys():
        for k in range(index.starts[index.terms[t]], index.starts[index.terms[t] + 1]):
            score[int(index.items[k])] = score.get(int(index.items[k]), 0.0) + index.weights[k]
    return {i for i, s in score.items() if s >= index.cfg.threshold - 1e-9}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.sampled_from([0.2, 0.4, 0.6]), st.integers(1, 9))
def test_wand_retrieves_all_above(seed, n, threshold, block):
    rng = random.Random(seed)
    index = Index(items(n, rng), DecontaminationConfig(threshold=threshold, block=block))
    for _ in range(10):
        passage = {f"w{rng.randrange(60)}" for _ in range(40)} | {f"answer{rng.randrange(n)}"}
        assert {i for i, _ in index.above(passage & index.terms.keys())} == brute_scores(index, passage)


def test_split():
    assert split_item("What is it? It is this. Forty two.") == ("What is it? It is this.", "Forty two.")
    assert split_item("only one") == ("only one", "") and split_item(None) == ("", "") and split_item("") == ("", "")
    assert len(ngrams([], 5)) == 0 and len(ngrams(["a", "b"], 5)) == 1 and len(ngrams(list("abcdefg"), 5)) == 3 and terms(None) == []


@pytest.fixture
def benchmark(spark):
    rng = random.Random(1)
    texts = [" ".join(f"bench{rng.randrange(400)}" for _ in range(30)) + f". Answer number{i} is thing{i}." for i in range(20)]
    return spark.createDataFrame([*enumerate(texts), (100, None), (101, ""), (None, "x"), (102, texts[3])], SCHEMA), texts


def test_planted_items_are_found(spark, corpus, docs, benchmark):
    bench, texts = benchmark
    planted = [(1000 + i, f"{corpus[i][1]} {t} {corpus[i + 1][1]}", "en", "s", 0) for i, t in enumerate(texts)]
    planted.append((2000, texts[0].split(".")[0], "en", "s", 0))
    planted.append((2001, corpus[140][1] if corpus[140][1] else "", "en", "s", 0))
    rows = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    found = {(r.doc_id, r.item_id) for r in contaminated(rows, bench).collect()}
    assert found == {(1000 + i, i) for i in range(20)} | {(1003, 102)}
    kept = {r.doc_id for r in keep_clean(rows, bench).select("doc_id").collect()}
    assert kept == {r[0] for r in corpus} | {2000, 2001}


def test_long_item_crosses_no_window(spark, benchmark):
    bench, texts = benchmark
    filler = " ".join(f"f{i}" for i in range(997))
    for lead in (0, 13, 30, 59, 71):
        text = " ".join(filler.split()[:lead]) + " " + texts[7] + " " + filler
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert [r.item_id for r in contaminated(rows, bench).collect()] == [7]


def test_blocks_of_items_and_edges(docs, odd_columns, empty, benchmark, spark):
    bench, texts = benchmark
    rows = spark.createDataFrame([(1, texts[2]), (2, texts[19]), (3, None)], "doc_id long, text string")
    cfg = DecontaminationConfig(index_chars=500)
    assert {(r.doc_id, r.item_id) for r in contaminated(rows, bench, cfg).collect()} == {(1, 2), (2, 19)}
    assert [r.doc_id for r in keep_clean(rows, bench, cfg).collect()] == [3]
    assert contaminated(empty, bench).count() == 0 and keep_clean(empty, bench).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert contaminated(docs, none).count() == 0 and keep_clean(docs, none).count() == docs.count()
    kept = keep_clean(odd_columns, bench)
    assert kept.columns == odd_columns.columns and kept.count() == odd_columns.count()
    answered = spark.createDataFrame([(1, "how many planets are there in our own system", "eight or nine of them")], "item_id long, text string, answer string")
    asked = spark.createDataFrame([(1, "how many planets are there in our own system eight or nine of them"), (2, "how many planets are there in our own system")], "doc_id long, text string")
    assert [r.doc_id for r in contaminated(asked, answered).collect()] == [1]


def brute(rows, items, cfg):
    """(doc, item) by scoring every passage against every item and comparing n-grams as words."""
    parts = {i: (terms(q), terms(a)) for i, q, a in items}
    df = Counter(t for q, a in parts.values() for t in set(q + a))
    lengths = [len(q + a) for q, a in parts.values()]
    mean, step, n = sum(lengths) / len(lengths), max(lengths), len(items)
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for doc, text in rows:
        words = terms(text)
        for at in range(0, max(1, len(words) - step), step):
            near = words[at : at + 2 * step]
            for i, (q, a) in parts.items():
                count, norm = Counter(q + a), cfg.k1 * (1 - cfg.b + cfg.b * len(q + a) / mean)
                weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (cfg.k1 + 1) / (c + norm) for t, c in count.items()}
                score = sum(w for t, w in weight.items() if t in set(near)) / sum(weight.values())
                share = [len(grams(x, min(5, len(x))) & grams(near, min(5, len(x)))) / len(grams(x, min(5, len(x)))) if x else 1 for x in (q, a)]
                if score >= cfg.threshold and share[0] >= cfg.question and share[1] >= cfg.answer:
                    out.add((doc, i))
    return out


@pytest.mark.parametrize("cfg", [DecontaminationConfig(), DecontaminationConfig(index_chars=400, held_chars=3000), DecontaminationConfig(index_bytes=6000, broadcast_bytes=9000)], ids=str)
def test_whole_query_is_the_brute_force_one(spark, cfg):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(300)}"
    texts = [" ".join(word() for _ in range(rng.randint(8, 30))) + ". " + " ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(40)]
    rows = []
    for i in range(120):
        held = texts[rng.randrange(40)].split()
        for _ in range(rng.randrange(6)):
            held[rng.randrange(len(held))] = word()
        if rng.random() < 0.3:
            held = held[: len(held) // 2]
        rows.append((i, " ".join([*(word() for _ in range(rng.randrange(200))), *held, *(word() for _ in range(rng.randrange(80)))])))
    items = [(i, *split_item(t)) for i, t in enumerate(texts)]
    expected = brute(rows, items, cfg)
    bench, frame = spark.createDataFrame([*enumerate(texts)], SCHEMA), spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.item_id) for r in contaminated(frame, bench, cfg).collect()} == expected and 20 < len(expected) < 120
    assert {r.doc_id for r in keep_clean(frame, bench, cfg).collect()} == set(range(120)) - {d for d, _ in expected}


def test_parts_are_within_their_bound(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(300)]
    cfg = DecontaminationConfig(index_bytes=50_000)
    parts = list(item_parts(spark.createDataFrame([*enumerate(texts)], SCHEMA), cfg))
    assert len(parts) > 3 and all(len(p) <= 50_000 for p in parts)
    assert sorted(i for p in parts for i in pickle.loads(p).ids) == list(range(300))


def test_workers_hold_one_part_at_a_time(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(400)]
    cfg = DecontaminationConfig(index_bytes=50_000)
    (group,) = passes(spark.createDataFrame([*enumerate(texts)], SCHEMA), cfg)
    assert len(group) >= 8

    def opened(batches):
        for _ in batches:
            for _ in range(2):
                ids = [i for part in group for i in unpacked(part).ids]
                yield pa.RecordBatch.from_pydict({"items": [len(ids)], "kept": [sum("_value" in part.__dict__ for part in group)]})

    rows = spark.range(4).mapInArrow(opened, "items long, kept long").collect()
    assert {(r["items"], r.kept) for r in rows} == {(400, 0)}
