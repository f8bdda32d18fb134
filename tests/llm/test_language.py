import math
import random

import numpy as np
import public_tokenizers
import pytest

from wavemark.llm.language import LanguageConfig, Segmenter, fit, forward, identify, vocabulary, words_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_ways(word, p, ids, unknown):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        i = ids.get(word[:k], unknown if k == 1 else None)
        if i is not None:
            total += p[i] * all_ways(word[k:], p, ids, unknown)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "bb"]
    s = Segmenter(pieces)
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces) + 1), 2).T
    words = ["▁ab", "▁abab", "▁", "▁zab", "bbb", "▁ababababab"]
    got = forward(s, words, p)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            assert row[k] == pytest.approx(math.log(all_ways(w, p[:, k], s.ids, s.unknown)))


def test_fitting_raises_the_likelihood():
    from collections import Counter

    s = Segmenter(["a", "b", "ab", "▁", "▁ab", "c", "cc"])
    counts = {"x": Counter({"▁abab": 30, "▁ab": 10, "▁b": 1}), "y": Counter({"▁cc": 20, "▁ccc": 9})}
    before = None
    for rounds in (1, 2, 4, 8):
        langs, p = fit(s, counts, rounds, 0.0001)
        assert langs == ["x", "y"] and np.allclose(p.sum(axis=0), 1)
        total = sum(n * forward(s, [w], p)[0, langs.index(lang)] for lang, c in counts.items() for w, n in c.items())
        assert before is None or total >= before - 0.05
        before = total


def test_words():
    assert words_of("Ab1c é") == ["ab", "c", "é"] and words_of(None) == [] == words_of("12 #") == words_of("")
    assert words_of("² ½ Ⅷ ① ٣ \u0301 _") == []
    assert words_of("x" * 60) == ["x" * 60]
    assert words_of("हिन्दी में cafe\u0301s, naïve²x") == ["हिन्दी", "में", "cafe\u0301s", "naïve", "x"]
    assert "▁the" in vocabulary(PATH)


def test_forward_on_a_very_long_word():
    """Against the same recursion in logarithms, place by place."""
    s = Segmenter(["a", "b", "ab", "ba", "aba", "▁", "▁a", "bb"])
    p = np.random.default_rng(1).dirichlet(np.ones(9), 3).T
    rng = random.Random(4)
    words = ["▁" + "".join(rng.choice("aabz") for _ in range(n)) for n in (5000, 3, 33, 40, 700)]
    got = forward(s, words, p)
    for w, row in zip(words, got, strict=True):
        for k in range(3):
            log = [0.0]
            for b in range(1, len(w) + 1):
                ways = [log[a] + math.log(p[i, k]) for a in range(max(0, b - 3), b) for i in [s.ids.get(w[a:b], s.unknown if b - a == 1 else None)] if i is not None]
                log.append(max(ways) + math.log(sum(math.exp(x - max(ways)) for x in ways)))
            assert row[k] == pytest.approx(log[-1], rel=1e-9)


def test_fitting_takes_long_words():
    from collections import Counter

    s = Segmenter(["a", "b", "ab", "▁", "▁a"])
    short = fit(s, {"x": Counter({"▁" + "ab" * 2: 1000})}, 3, 0.01)[1]
    long = fit(s, {"x": Counter({"▁" + "ab" * 2000: 1})}, 3, 0.01)[1]
    assert np.isfinite(long).all() and long.sum() == pytest.approx(1) and short[2, 0] > short[1, 0] and long[2, 0] > long[1, 0]


def test_texts_without_letters_are_undetermined(spark, docs):
    odd = ["² ½ Ⅷ ①", "", "12 34", "\u0301", None, "__ --"]
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(7000 + i, t, "en") for i, t in enumerate(odd)], "doc_id long, text string, lang string"))
    got = [(r.lang_pred, r.score) for r in identify(rows, LanguageConfig(PATH)).filter("doc_id >= 7000").collect()]
    assert got == [("und", 0.0)] * len(odd)


def test_prediction(spark, docs, corpus, empty, odd_columns):
    cfg = LanguageConfig(PATH)
    rows = identify(docs, cfg).collect()
    assert len(rows) == len(corpus)
    truth = {r[0]: r[2] for r in corpus[:120]}
    assert all(r.lang_pred == truth[r.doc_id] for r in rows if r.doc_id in truth and r.doc_id != 20)
    assert any(r.held_out for r in rows) and all(0 <= r.score <= 1 for r in rows)
    texts = {r[0]: r[1] for r in corpus}
    for r in rows:
        if not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}
    assert identify(empty, cfg).count() == 0
    assert identify(odd_columns, cfg).count() == len(corpus)
    unknown = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in identify(unknown, cfg).collect()} == {"und"}


def test_language_column_is_no_input(spark, docs):
    cfg = LanguageConfig(PATH)
    a = {(r.doc_id, r.lang_pred, r.score) for r in identify(docs, cfg).collect() if r.held_out}
    lied = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'zz', lang) lang")
    assert a == {(r.doc_id, r.lang_pred, r.score) for r in identify(lied, cfg).collect() if r.held_out}


def test_very_long_text(spark):
    rng = random.Random(0)
    text = " ".join(rng.choice(["the", "thing", "other"]) for _ in range(30000)) + "q" * 5000
    rows = spark.createDataFrame([(1, "the other thing", "en"), (3, "das andere ding", "de"), (4, text, None), (8, "the thing", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(rows, LanguageConfig(PATH)).collect()}
    assert got[4].lang_pred == "en"
