import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wavemark.llm import kneser_ney as kn

CFG = kn.KneserNeyConfig()


def signs(word, order):
    return [" "] * (order - 1) + list(word) + ["\r"]


def brute(texts, order=CFG.order):
    """The same model by plain dictionaries: a function of (context, sign)."""
    counts = Counter()
    for t in texts:
        for w in (t or "").encode().split():
            s = signs(w.decode(), order)
            counts.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    levels = [counts]
    for _ in range(order - 1):
        lower = Counter()
        for g in levels[0]:
            lower[g[1:]] += 1
        levels.insert(0, lower)
    tables = []
    for level in levels:
        few = Counter(level.values())
        d = kn.discounts(few[1], few[2], few[3], few[4])
        contexts = defaultdict(lambda: [0, 0.0])
        for g, n in level.items():
            contexts[g[:-1]][0] += n
            contexts[g[:-1]][1] += d[min(n, 3) - 1]
        tables.append((level, contexts, d))

    def p(context, w):
        level, contexts, d = tables[len(context)]
        lower = p(context[1:], w) if context else 1 / (len(levels[0]) + 1)
        if context not in contexts:
            return lower
        total, mass = contexts[context]
        n = level.get((*context, w), 0)
        return ((n - d[min(n, 3) - 1]) / total if n else 0.0) + mass / total * lower

    return p


def brute_perplexity(p, text, order=CFG.order):
    bits = n = 0
    for w in text.encode().split():
        s = signs(w.decode(), order)
        bits += sum(-math.log2(p(tuple(s[i - order + 1 : i]), s[i])) for i in range(order - 1, len(s)))
        n += len(s) - order + 1
    return 2 ** (bits / n)


STRANGE = ["ελληνικά λέξεις και άλλες λέξεις", "汉字" * 40 + "的是不了人我在有他", "кириллица слова слова", "x" * 90 + "yz" * 30, "Zz é\n\U0001f600 2023", "the an er " * 300]


@pytest.mark.parametrize("cfg", [CFG, kn.KneserNeyConfig(order=3, pack_bytes=700, group_bytes=3_000, group_grams=900)], ids=str)
def test_perplexities_are_the_brute_force_ones(spark, corpus, cfg):
    """Trained on the first texts, other scripts included, and scored on all of both kinds."""
    texts = [r[1] for r in corpus[:25]] + STRANGE
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, r[1]) for i, r in enumerate(corpus[25:])), (5000, "ж汉x unseen–signs")], "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(3)
    packed = kn.packed_documents(docs, cfg)
    ids = spark.range(len(texts)).withColumnRenamed("id", "doc_id")
    model = kn.train(kn.gram_counts(packed, ids, cfg), cfg)
    got = {(r.doc_id, r.text_key): r for r in kn.with_perplexity(packed, model).collect()}
    p = brute(texts, cfg.order)
    rows = docs.withColumn("key", F.xxhash64("text")).collect()
    assert len(rows) == len(texts) + len(corpus) - 25 + 1
    for r in rows:
        found = got[(r.doc_id, r.key)]
        if (r.text or "").encode().split():
            assert found.has_words and found.perplexity == pytest.approx(brute_perplexity(p, r.text, cfg.order), rel=1e-4)
        else:
            assert not found.has_words and found.perplexity is None


def test_probabilities_sum_to_one(spark, corpus):
    texts = [r[1] for r in corpus[:10]]
    p = brute(texts)
    alphabet = {c for t in texts for c in t if not c.isspace()} | {"\r", "never seen"}
    for context in (" " * 4, "  th", "zzzz", "tion"):
        assert sum(p(tuple(context), c) for c in alphabet) == pytest.approx(1)


@pytest.mark.parametrize("order", [1, 3, 5])
def test_grams(order, monkeypatch):
    """Of words of any length, in slices of a few characters."""
    text = "word \t\nx " + "ab" * 40 + "\x0b汉字\u00a0é\n"
    expected = [tuple(s[i - order + 1 : i + 1]) for w in text.encode().split() for s in [signs(w.decode(), order)] for i in range(order - 1, len(s))]
    points = kn.np.frombuffer(text.encode("utf-32-le"), kn.np.uint32)
    for size in (1 << 18, 7, 1):
        monkeypatch.setattr(kn, "SLICE", size)
        found = [x for _, grams in kn.grams_in(points, order) for x in zip(*grams, strict=True)]
        assert [tuple(map(chr, x)) for x in found] == expected


def test_discounts():
    assert kn.discounts(0, 1, 1, 1) == (0.5, 1.0, 1.5)
    assert kn.discounts(10, 5, 3, 2) == pytest.approx((0.5, 1.1, 5 / 3), abs=0.01)


def test_filter(spark, docs, labels, empty, odd_columns, corpus):
    got = {}
    for r in kn.quality(docs, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    junk = {r[0] for r in corpus if r[1] and "###" in r[1]}
    assert not any(r.kept for i in junk for r in got[i])
    kept = sum(r.kept for rows in got.values() for r in rows)
    assert kept > 0.8 * len(corpus) and sum(map(len, got.values())) == len(corpus)
    blank = [r[0] for r in corpus if not (r[1] or "").encode().split()]
    assert blank and all(not got[i][0].kept and got[i][0].perplexity is None for i in blank)
    assert len(got[10]) == 2 and got[10][0].perplexity == got[10][1].perplexity
    out = kn.keep_good(odd_columns, labels)
    assert out.columns == odd_columns.columns and out.count() == kept
    expected = sorted(str(r.doc_id) for rows in got.values() for r in rows if r.kept)
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == expected
    assert kn.quality(empty, labels).count() == 0 == kn.keep_good(empty, labels).count()
    assert kn.keep_good(docs, labels.limit(0)).count() == len(corpus) - len(blank)


def test_threshold_is_the_languages_own(spark):
    scored = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i)) for i in range(4000)], "doc_id long, lang string, perplexity double")
    labels = spark.createDataFrame([(i, 1) for i in range(4000)], "doc_id long, quality int")
    cuts = {(r.lang, r.pooled): r.threshold for r in kn.thresholds(scored, labels, kn.KneserNeyConfig(quantile=0.5)).collect()}
    assert cuts.keys() == {("a", False), ("b", False), (None, True)} and all(1800 < v < 2200 for v in cuts.values())
