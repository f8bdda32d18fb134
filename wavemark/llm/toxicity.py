"""Operator 3: toxicity categories by a classifier chain of linear models.

The chain predicts one category after another. Each link is a logistic model of the tokens that
stand in a text and of the probabilities of all categories before it. In training these are
out-of-fold: for each link, folds of the training rows are predicted by models fitted without them,
so a later link learns from probabilities as uncertain as those it will meet, and not from an
earlier link's memory of its own training rows. Scoring runs the links in order.

Models are fitted on the driver on a bounded sample of labelled texts (`sample`, drawn by a hash of
the text from the distinct texts that labelled documents hold; the bound is the only thing that does
not grow with the input), by proximal gradient steps with an L1 penalty, on tokens whose association
with the category is strong and beyond chance. What the driver gets are those tokens of the sample
that `least_docs` of its texts hold, not texts. Folds go by the least hash of a text's five-word
shingles, so near copies mostly stand in one fold. Every document is then scored in whole where it
is read, without a shuffle. Each category's cut-off is the one with the best F1 on the out-of-fold
probabilities, but at least one half.

Tokens are runs of letters in lower case, with the stems of longer ones, and runs of other signs.
Cases: a null or empty text has no tokens and the base rate's probability; a very long text is a set
of tokens like any other; labels of absent documents and null labels teach nothing and take no place
in the sample; an id with several labels counts with its worst, and so does a text with several ids;
a category without labels of both kinds has probability 0; a probability that ties with the cut-off
is flagged; equal rows score equally; without labels nothing is flagged; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pickled_size, session_broadcast, window_hashes, word_hashes, written

TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


@dataclass(frozen=True)
class ChainConfig:
    """sample: labelled rows learned from at most; evidence and strength: least chi-square of
    a token, and least share of the sample's that it is."""

    sample: int = 8_000
    folds: int = 3
    least_docs: int = 5
    evidence: float = 20.0
    strength: float = 0.01
    features: int = 2_000
    penalty: float = 2e-4
    steps: int = 300


def tokens(text: str | None) -> set[str]:
    """Tokens of a text, and the first four and five letters of longer words, marked ^: a stem
    stands for inflections that the sample does not hold."""
    found = set(TOKEN.findall(text.lower())) if text else set()
    return found | {"^" + w[:4] for w in found if len(w) > 4} | {"^" + w[:5] for w in found if len(w) > 5}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Link:
    """One linear model: weights of tokens and of the chain's earlier probabilities, and a bias."""

    def __init__(self, tokens: dict[str, float], chain: np.ndarray, bias: float) -> None:
        self.tokens, self.chain, self.bias = tokens, chain, bias

    def margin(self, found: set[str], earlier: list[float]) -> float:
        known = self.tokens.keys() & found
        # In a fixed order, so that equal texts score equally to the last bit.
        return self.bias + float(sum(sorted(map(self.tokens.__getitem__, known)))) + float(np.dot(self.chain, earlier))

    def probability(self, found: set[str], earlier: list[float]) -> float:
        return float(sigmoid(np.array(self.margin(found, earlier))))


class Bag:
    """The tokens of the training rows as numbers: pairs of row and token."""

    def __init__(self, found: list[Iterable[str]]) -> None:
        ids: dict[str, int] = {}
        docs = [np.fromiter((ids.setdefault(t, len(ids)) for t in some), np.int32) for some in found]
        self.names, self.n = [*ids], len(docs)
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), [len(d) for d in docs])
        self.cols = np.concatenate(docs) if docs else np.zeros(0, np.int32)


def fit_weights(bag: Bag, use: np.ndarray, earlier: np.ndarray, y: np.ndarray, cfg: ChainConfig) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of all tokens, of the earlier probabilities, and the bias, from the rows in `use`: a
    logistic model with an L1 penalty; tokens are first chosen by chi-square."""
    size, n, positive = len(bag.names), int(use.sum()), int(y[use].sum())
    weights, c = np.zeros(size), np.zeros(earlier.shape[1])
    if not 0 < positive < n:
        return weights, c, 30.0 if positive else -30.0
    held = use[bag.rows]
    rows, cols = bag.rows[held], bag.cols[held]
    df, inside = np.bincount(cols, minlength=size).astype(float), np.bincount(cols, y[rows], size)
    fine = np.flatnonzero((df >= cfg.least_docs) & (df < n))
    off = inside[fine] * n - df[fine] * positive
    value = n * off * off / (df[fine] * (n - df[fine]) * positive * (n - positive))
    order = np.lexsort(([bag.names[i] for i in fine], -value))[: cfg.features] if len(fine) else np.zeros(0, int)
    chosen = fine[order][value[order] >= max(cfg.evidence, cfg.strength * n)]
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    known = place[cols] >= 0
    at = np.cumsum(use) - 1
    rows, cols, width = at[rows[known]], place[cols[known]], len(chosen)
    earlier, y = earlier[use], y[use]
    w, b = np.zeros(width), float(np.log(positive / (n - positive)))
    sums = np.ones(width), np.ones(len(c)), 1.0
    for _ in range(cfg.steps):
        off = (sigmoid(b + earlier @ c + np.bincount(rows, w[cols], n)) - y) / n
        grads = np.bincount(cols, off[rows], width), earlier.T @ off, off.sum()
        sums = tuple(s + 1e4 * g * g for s, g in zip(sums, grads, strict=True))
        rates = [20.0 / np.sqrt(s) for s in sums]
        w = w - rates[0] * grads[0]
        w = np.sign(w) * np.maximum(0, np.abs(w) - rates[0] * cfg.penalty)
        c, b = c - rates[1] * grads[1], b - rates[2] * grads[2]
    weights[chosen] = w
    return weights, c, float(b)


class Chain:
    """Links in the order of the categories, with each category's cut-off."""

    def __init__(self, categories: list[str], links: list[Link], cuts: list[float]) -> None:
        self.categories, self.links, self.cuts = categories, links, cuts

    def probabilities(self, text: str | None) -> list[float]:
        found, out = tokens(text), []
        for link in self.links:
            out.append(link.probability(found, out))
        return out


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which F1 is best, at least one half; 1 if nothing is to be found."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits, ranks = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)
    f1 = np.where(last, 2 * hits / (ranks + y.sum()), 0)
    best = int(f1.argmax())
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return max(0.5, float((p[order][best] + below) / 2))


def train(found: list[Iterable[str]], labels: np.ndarray, folds_of: np.ndarray, categories: list[str], cfg: ChainConfig) -> Chain:
    """Fits the chain to rows of tokens; labels is rows by categories, folds_of each row's fold."""
    bag = Bag(found)
    earlier, links, cuts, every = np.zeros((bag.n, 0)), [], [], np.ones(bag.n, bool)
    for k in range(len(categories)):
        y, oof = labels[:, k].astype(float), np.zeros(bag.n)
        for fold in range(cfg.folds):
            out = folds_of == fold
            if out.any() and not out.all():
                w, c, b = fit_weights(bag, ~out, earlier, y, cfg)
                oof[out] = sigmoid(b + earlier @ c + np.bincount(bag.rows, w[bag.cols], bag.n))[out]
        w, c, b = fit_weights(bag, every, earlier, y, cfg) if bag.n else (np.zeros(0), np.zeros(k), -30.0)
        links.append(Link({bag.names[i]: float(w[i]) for i in np.flatnonzero(w)}, c, b))
        cuts.append(best_cut(oof, y))
        earlier = np.column_stack([earlier, oof])
    return Chain(categories, links, cuts)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], cfg: ChainConfig | None = None) -> Chain:
    """Draws the sample and fits the chain. categories: a condition on `labels` for each name, in
    the order of the chain."""
    cfg = cfg or ChainConfig()
    names = [f"y_{name}" for name in categories]
    rows = labels.filter("doc_id is not null").select("doc_id", *[c.cast("int").alias(f"y_{name}") for name, c in categories.items()])
    rows = rows.groupBy("doc_id").agg(*[F.max(y).alias(y) for y in names]).dropna()
    held = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("key")).join(rows, "doc_id").groupBy("key").agg(*[F.max(y).alias(y) for y in names])
    drawn = written(held.orderBy(F.xxhash64("key", F.lit("toxicity")), "key").limit(cfg.sample), "tox-drawn", 1)

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    shingles = window_hashes(word_hashes(text.encode().lower().split()), 5)
                    out.append((key, int(shingles.min() % np.uint64(cfg.folds)) if len(shingles) else 0, sorted(tokens(text))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.string())), strict=True)], ["key", "fold", "tokens"])

    # At most `sample` keys, so they may be broadcast.
    found = docs.filter("text is not null").select(F.xxhash64("text").alias("key"), "text").join(F.broadcast(drawn.select("key")), "key", "left_semi")
    found = written(found.mapInArrow(tokenised, "key long, fold int, tokens array<string>").dropDuplicates(["key"]), "tox-tokens")
    flat = found.select("key", F.explode("tokens").alias("token"))
    common = flat.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= cfg.least_docs).select("token")
    kept = flat.join(common, "token").groupBy("key").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    table = found.select("key", "fold").join(drawn, "key").join(kept, "key", "left").orderBy("key").toArrow()
    y = np.column_stack([table.column(c).to_numpy() for c in names]) if table.num_rows else np.zeros((0, len(names)))
    return train([x or [] for x in table.column("tokens").to_pylist()], y, table.column("fold").to_numpy(), [*categories], cfg)


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category>..., <category>...): probability of each category and whether it
    reaches its cut-off, for every document."""
    shared = session_broadcast(docs.sparkSession, chain, pickled_size(chain), 16 << 20)
    names = ["doc_id", *[f"p_{c}" for c in chain.categories], *chain.categories]
    schema = ", ".join(["doc_id long", *[f"p_{c} double" for c in chain.categories], *[f"{c} boolean" for c in chain.categories]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            p = np.array([chain.probabilities(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(chain.links))
            columns = [pa.array(x, pa.float64()) for x in p.T] + [pa.array(x >= cut, pa.bool_()) for x, cut in zip(p.T, chain.cuts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def label_categories() -> dict[str, Column]:
    """The chain over the columns of the labels table: poor quality first, then toxicity given it,
    then both together given each."""
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"poor": poor, "toxic": toxic, "poor_and_toxic": poor & toxic}


def toxic_documents(docs: DataFrame, labels: DataFrame, cfg: ChainConfig | None = None) -> DataFrame:
    """The documents flagged toxic, with the probabilities and flags of the whole chain."""
    return scored(docs, fit(docs, labels, label_categories(), cfg)).filter("toxic")
