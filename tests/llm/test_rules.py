import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wavemark.llm.rules import RULES, binomial_below, cutoffs, features, judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    spots = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(spots)


def test_features_are_brute_force(docs, corpus, odd_columns):
    rows = features(docs, ["doc_id", "text"]).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        got = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words
        assert got == brute(r.text)
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
    assert features(odd_columns, ["doc_id"]).count() == len(corpus)


@pytest.mark.parametrize(("n", "p"), [(10, 0.1), (100, 0.01), (1000, 0.05), (20000, 0.01), (300000, 0.01)])
def test_binomial_tail(spark, n, p):
    for k in {0, 1, int(n * p / 2), int(n * p), int(n * p) + 1}:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        got = spark.range(1).select(binomial_below(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == (1.0 if k > n * p else pytest.approx(exact, rel=1e-6))


def made(spark, n, bad, lang="en"):
    """n good documents, `bad` of which have many symbols."""
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join([f"own{i:05d}", *words]) + (" $" * 40 if i < bad else ""), lang) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")


def test_strictest_safe_cutoff(spark):
    docs, labels = made(spark, 2000, 0)
    cut = cutoffs(features(docs, ["doc_id", "lang"]), labels, "lang").first()
    assert cut.cut_symbols == RULES["symbols"][1][0] and cut.cut_repeats == RULES["repeats"][1][0]
    # 40 of 2000 good documents lie above all but the last candidates: more than the risk allows.
    docs, labels = made(spark, 2000, 40)
    cut = cutoffs(features(docs, ["doc_id", "lang"]), labels, "lang").first()
    assert cut.cut_symbols == 0.5


def test_few_labels_prove_nothing(spark):
    docs, labels = made(spark, 80, 0)
    rows = judge(docs, labels).collect()
    assert all(r.kept for r in rows)
    cut = cutoffs(features(docs, ["doc_id", "lang"]), labels, "lang").first()
    assert cut.cut_symbols is None


def test_rules_reject_per_stratum(spark):
    docs, labels = made(spark, 1500, 0)
    more = spark.createDataFrame([(9000, " ".join(f"w{i} $" for i in range(60)), "en"), (9001, " ".join(f"w{i} $" for i in range(60)), "de"), (9002, None, "en")], docs.schema)
    got = {r.doc_id: r for r in judge(docs.unionByName(more), labels).filter("doc_id >= 9000").collect()}
    assert (got[9000].kept, got[9001].kept, got[9002].kept) == (False, True, False)


def test_edges(docs, labels, empty, corpus):
    rows = judge(docs, labels).collect()
    assert len(rows) == len(corpus)
    assert judge(empty, labels).count() == 0 and judge(docs, labels.limit(0)).count() == len(corpus)


def test_copies_prove_nothing(spark, docs):
    words = " ".join(f"word{i}" for i in range(60))
    once, many = spark.createDataFrame([(1, words, "en")], "doc_id long, text string, lang string"), spark.createDataFrame([(i, words, "en") for i in range(2000)], "doc_id long, text string, lang string")
    for rows in (once.crossJoin(spark.range(2000)).drop("id"), many):
        cut = cutoffs(features(rows, ["doc_id", "lang"]), spark.range(2000).selectExpr("id doc_id", "1 quality"), "lang").first()
        assert set(cut[1:]) == {None}


def test_ids_with_both_labels_are_no_trials(spark):
    docs, labels = made(spark, 2000, 0)
    both = labels.unionByName(labels.withColumn("quality", F.lit(0)))
    assert cutoffs(features(docs, ["doc_id", "lang"]), both, "lang").count() == 0


def test_odd_columns(odd_columns, docs, labels):
    assert sorted(map(str, judge(odd_columns, labels).collect())) == sorted(map(str, judge(docs, labels).collect()))
