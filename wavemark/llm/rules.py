"""Operator 8: quality rules with risk-controlled cut-offs, in DataFrame operations.

Five rules each reject a document whose value is above a cut-off. Cut-offs are not set by hand: for
each stratum (language), rule and candidate of a fixed grid, the labelled good documents are a
holdout of n trials of which k would be rejected, and the candidate stands only if the exact
binomial test shows the true rate of false rejection to be at most the rule's share of `risk`
(P(X <= k) for n trials at that rate is at most the test's share of `miss`). The shares are
Bonferroni's: risk over the rules, miss over all tests of all strata. The strictest candidate that
stands is the cut-off, and a rule of which none stands rejects nothing in that stratum. So, with
probability 1 - miss, these rules cost no stratum more than `risk` of its distinct good texts. The
base rules are given, not chosen, and what they reject is beyond this.

A trial is a distinct text of a stratum, however many rows and ids hold it: copies are no further
evidence. Near copies are trials of their own. A good document is one that all its labels call good.

Repeated words are found within each row: the hashes of its three-word windows are sorted with
their places, and equal neighbours mark places, so no window leaves its row.

Cases: a null or empty text has no words, fails the base rules and is no trial; a very long text is
one trial; null is a stratum of its own, and one without labels has no cut-offs; labels of absent
documents, and null labels, do not count; an id on several rows is tried with each of its texts; a
value that ties with a cut-off passes; equal rows get equal verdicts; empty tables are allowed; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Each rule's value, which is rejected above the cut-off, and its candidates from strict to lax.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0)),
    "dup_lines": ("n_dup_lines / n_lines", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("n_repeat_words / n_words", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)),
    "long_words": ("word_chars / n_words", (6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0)),
    "short_words": ("-word_chars / n_words", (-5.0, -4.75, -4.5, -4.25, -4.0, -3.5, -3.0, -2.5)),
}
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in three-word windows found twice or more in it."""
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at"))))
    windows = F.coalesce(windows, F.array().cast("array<struct<h:bigint,at:int>>"))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    return covered(let(F.sort_array(windows), places))


def features(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry`, text_key and the counts of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select(
        *carry, F.xxhash64("text").alias("text_key"), counted.alias("__words"), by_line.alias("__lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(*carry, "text_key", F.col("__words.n_words"), "word_chars", "n_symbols", F.col("__lines.n_dup_lines"), F.col("__words.n_repeat_words"), F.col("__lines.n_lines"))
    return rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def log_factorial(n: Column) -> Column:
    """ln n!: exact products up to 20, Stirling's series (error below 1e-15) from there."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_below(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials at rate p, summed from k down until terms vanish; 1 where k is above
    the mean, since no test can stand there."""
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, F.ceil(40 * F.sqrt(n * (p * (1 - p))) + 60))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) / (n - k + i) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")), start, down, lambda acc: acc["sum"])
    return F.when(k > n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def cutoffs(rows: DataFrame, labels: DataFrame, stratum: str, risk: float = 0.05, miss: float = 0.05) -> DataFrame:
    """(stratum, cut_<rule>...) from rows that hold doc_id, the stratum, text_key and the counts."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("worst")).filter("worst = 1").select("doc_id")
    held = rows.filter("n_words > 0").join(good, "doc_id", "left_semi").dropDuplicates([stratum, "text_key"])
    counts = [F.sum(F.expr(f"if({value} > {c}D, 1L, 0L)")).alias(f"{rule}_{i}") for rule, (value, grid) in RULES.items() for i, c in enumerate(grid)]
    tried = written(held.groupBy(stratum).agg(F.count("*").alias("n"), *counts), "rules-trials", 1)
    tests = tried.count() * sum(len(grid) for _, grid in RULES.values())
    share = miss / max(1, tests)
    # Candidates run from strict to lax: the first that stands is the strictest.
    cuts = [F.coalesce(*[F.when(binomial_below(F.col(f"{rule}_{i}"), F.col("n"), risk / len(RULES)) <= share, F.lit(c)) for i, c in enumerate(grid)]).alias(f"cut_{rule}") for rule, (_, grid) in RULES.items()]
    return tried.select(stratum, *cuts)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, miss: float = 0.05) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, kept and the stratum."""
    rows = written(features(docs, ["doc_id", stratum]), "rules-rows")
    cuts = written(cutoffs(rows, labels, stratum, risk, miss), "rules-cuts", 1).withColumnRenamed(stratum, "__stratum")
    out = rows.join(cuts, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    fine = [F.coalesce(F.expr(f"if(n_words > 0, {value}, null)") <= F.col(f"cut_{rule}"), F.lit(True)) for rule, (value, _) in RULES.items()]
    verdict = ~F.col("base_failed")
    for x in fine:
        verdict = verdict & x
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), stratum)


def _sql() -> str:
    counts = ", ".join(f"sum(CASE WHEN {v.replace(' / ', '::DOUBLE / ')} > {c} THEN 1 ELSE 0 END) AS {r}_{i}" for r, (v, grid) in RULES.items() for i, c in enumerate(grid))
    tests = sum(len(grid) for _, grid in RULES.values())
    p = 0.05 / len(RULES)
    below = "list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(P) + (n - j) * ln(1 - P))))".replace("P", repr(p))
    cuts = ", ".join(f"coalesce({', '.join(f'CASE WHEN {below.replace("k + 1", f"{r}_{i}::BIGINT + 1")} <= 0.05 / ((SELECT count(*) FROM tried) * {tests}) THEN {c} END' for i, c in enumerate(grid))}) AS cut_{r}" for r, (_, grid) in RULES.items())
    fine = " AND ".join(f"coalesce({v.replace(' / ', '::DOUBLE / ')} <= cut_{r}, true)" for r, (v, _) in RULES.items())
    return rf"""
WITH w AS (
    SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents
), g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
rep AS (SELECT r, count(DISTINCT spot) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS spot FROM g2 WHERE n > 1) GROUP BY r),
f AS (
    SELECT r, doc_id, lang, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN rep USING (r)
), tried AS (
    SELECT lang, count(*) AS n, {counts}
    FROM (SELECT DISTINCT ON (lang, t) * FROM f WHERE n_words > 0 AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)) GROUP BY lang
), cuts AS (SELECT lang, {cuts} FROM tried),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {fine} AS kept
FROM b LEFT JOIN cuts ON b.lang IS NOT DISTINCT FROM cuts.lang
"""


SQL = _sql()
