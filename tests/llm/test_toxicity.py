import random

import numpy as np
import pytest

from wavemark.llm.toxicity import Chain, ChainConfig, best_cut, fit, label_categories, scored, tokens, toxic_documents, train


def made(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        poor, rude = rng.random() < 0.3, rng.random() < 0.3
        if poor:
            words += ["|"] * 3
        if rude:
            words += [rng.choice(["vilea", "vileb", "nasty"])] * 2
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((int(poor), int(rude), int(poor and rude)))
    return texts, np.array(labels)


def test_chain_generalises():
    texts, y = made(900, 1)
    chain = train([tokens(t) for t in texts], y, np.arange(900) % 3, ["poor", "rude", "both"], ChainConfig())
    fresh, truth = made(400, 2)
    p = np.array([chain.probabilities(t) for t in fresh])
    for k in range(3):
        assert ((p[:, k] >= chain.cuts[k]) == truth[:, k]).mean() > 0.97
    # The last link leans on the probabilities before it.
    assert chain.links[2].chain[:2].min() > 0.5 and len(chain.links[0].chain) == 0


def test_out_of_fold_is_used():
    """Labels of pure noise: in-fold predictions would look informative, out-of-fold ones do not."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"u{i}x{j}" for j in range(5)) for i in range(300)]
    y = rng.integers(0, 2, (300, 1))
    chain = train([tokens(t) for t in texts], np.column_stack([y, y]), np.arange(300) % 3, ["a", "b"], ChainConfig(least_docs=1, evidence=0, strength=0))
    assert abs(chain.links[1].chain[0]) < 3


def test_tokens():
    assert tokens(None) == set() == tokens("")
    assert tokens("Stupid!! a") == {"stupid", "!!", "a", "^stup", "^stupi"}


def test_best_cut():
    assert best_cut(np.array([0.9, 0.8, 0.1]), np.array([1, 1, 0])) == 0.5
    assert best_cut(np.array([0.9, 0.7, 0.1]), np.array([1.0, 0.0, 0.0])) == pytest.approx(0.8)
    assert best_cut(np.zeros(3), np.zeros(3)) == 1.0


def test_spark_and_edges(spark, docs, labels, empty, odd_columns, corpus):
    rude = spark.createDataFrame([(5000 + i, f"{corpus[i][1]} vilething vilestuff", "en", "s", 0) for i in range(60)], docs.schema)
    rows = docs.unionByName(rude)
    truth = labels.unionByName(spark.createDataFrame([(5000 + i, 1, 1) for i in range(40)], labels.schema))
    flagged = {r.doc_id for r in toxic_documents(rows, truth).collect()}
    assert flagged == {5000 + i for i in range(60)}
    assert toxic_documents(empty, truth).count() == 0
    assert toxic_documents(docs, truth.limit(0)).count() == 0
    chain = fit(rows, truth, label_categories())
    out = scored(odd_columns, chain)
    assert out.count() == odd_columns.count()
    twice = [r.p_toxic for r in out.filter("doc_id = 10").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_sample_bound(spark, docs, labels):
    assert isinstance(fit(docs, labels, label_categories(), ChainConfig(sample=10)), Chain)


def test_absent_labels_take_no_place(spark, docs, corpus):
    """And neither do copies: the sample is of distinct texts that are there."""
    rude = spark.createDataFrame([(5000 + i, f"{corpus[i % 60][1]} vilething vilestuff", "en", "s", 0) for i in range(60)], docs.schema)
    rows = docs.unionByName(rude)
    truth = [(r[0], 1, 0) for r in corpus if r[0] is not None] + [(5000 + i, 1, 1) for i in range(60)] + [(10**6 + i, 1, 0) for i in range(20_000)]
    copies = spark.createDataFrame([(8000 + i, corpus[0][1], "en", "s", 0) for i in range(500)], docs.schema)
    truth += [(8000 + i, 1, 0) for i in range(500)]
    flagged = {r.doc_id for r in toxic_documents(rows.unionByName(copies), spark.createDataFrame(truth, "doc_id long, quality int, toxic int"), ChainConfig(sample=250)).collect()}
    assert flagged == {5000 + i for i in range(60)}


def test_scores_are_the_links_in_order():
    """Against dense matrices: each link sees the tokens and the probabilities of the links before."""
    texts, y = made(300, 3)
    chain = train([tokens(t) for t in texts], y, np.arange(300) % 3, ["poor", "rude", "both"], ChainConfig())
    names = sorted(set().union(*map(tokens, texts)))
    x = np.array([[n in tokens(t) for n in names] for t in texts], float)
    earlier = np.zeros((300, 0))
    for link in chain.links:
        w = np.array([link.tokens.get(n, 0.0) for n in names])
        p = 1 / (1 + np.exp(-(x @ w + earlier @ link.chain + link.bias)))
        earlier = np.column_stack([earlier, p])
    assert np.allclose(earlier, [chain.probabilities(t) for t in texts])
    shuffled = train([tokens(t) for t in texts[::-1]], y[::-1], (np.arange(300) % 3)[::-1], ["poor", "rude", "both"], ChainConfig())
    assert np.allclose([shuffled.probabilities(t) for t in texts], earlier, atol=1e-6)
