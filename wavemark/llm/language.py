"""Operator 5: language identification by unigrams marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word is written in
pieces in many ways; its probability in a language is the sum over all of them, which the forward
algorithm finds in one pass over the word. Expected piece counts from forward and backward sums fit
the probabilities (expectation maximisation), smoothed toward all languages together. A text's
score in a language is the sum of its words' log probabilities; the answer is the language with the
largest, and its posterior under equal priors is the score.

Words are runs of letters with the marks on them, in lower case, after the vocabulary's word mark. A
letter outside the vocabulary is a piece of its own kind. A word of any length is summed over whole:
the sums are scaled as they go, and only those within the longest piece of the place reached matter.

Learning uses the texts and languages of at most about `per_language` documents of each language,
drawn by a hash of the id; every document is scored in whole, and neither its language column nor
its source or id is an input of that.

Cases: a null or empty text, or one without letters, is `und` with score 0, as is every text when
nothing could be learned; digits, fractions and numerals are no letters; very long texts and words
are scored whole; of languages that tie, the first by code point is told; documents without language
or id teach nothing; equal rows get equal answers; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pickled_size, process_state, session_broadcast

MARK = "▁"
#: Runs of ASCII letters, and of what may be letters and marks beyond: letters, numerals and all else
#: that is neither white space nor an ASCII sign.
ASCII = re.compile(r"[a-z]+")
WIDE = re.compile(r"[a-z\u0080-\U0010ffff]+")
#: Words whose log probabilities a worker process keeps.
CACHE = 400_000
#: Cells of one lattice, of words by places by languages; a longer word is a lattice of its own.
CELLS = 1_000_000
#: Places after which sums are scaled.
STRIDE = 16


@dataclass(frozen=True)
class LanguageConfig:
    """vocabulary: path of a sentencepiece model; per_language: documents learned from, about."""

    vocabulary: str
    per_language: int = 400
    rounds: int = 4
    smoothing: float = 0.05


class _Kinds(dict):
    """For str.translate: letters and marks stay, and all else parts words."""

    def __missing__(self, cp: int) -> str:
        self[cp] = found = chr(cp) if unicodedata.category(chr(cp))[0] in "LM" else " "
        return found


_KINDS = _Kinds()


def words_of(text: str | None) -> list[str]:
    """Runs of letters, with the marks that follow letters, in lower case."""
    if not text:
        return []
    text = text.lower()
    if text.isascii():
        return ASCII.findall(text)
    runs = WIDE.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    out = []
    for run in runs:
        if run.isalpha():
            out.append(run)
        else:
            for word in run.translate(_KINDS).split():
                if not word[0].isalpha():  # marks on nothing
                    word = word.lstrip("".join({c for c in word if not c.isalpha()}))
                if word:
                    out.append(word)
    return out


def vocabulary(path: str) -> list[str]:
    """The pieces that can stand in lower-case words."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    letters = lambda t: all(unicodedata.category(c)[0] in "LM" for c in t)
    return [p for p in pieces if p and p == p.lower() and letters(p.removeprefix(MARK))]


class Segmenter:
    """All ways to write words in pieces, as the edges of one lattice for each word. Pieces are
    followed letter by letter in a trie whose steps stand in a table by the hash of node and letter."""

    def __init__(self, pieces: list[str]) -> None:
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        steps: dict[tuple[int, int], int] = {}
        piece = [-1]
        for p, i in self.ids.items():
            node = 0
            for c in map(ord, p):
                node = steps.setdefault((node, c), len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = i
        self.piece = np.array(piece, np.int32)
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for (node, c), to in steps.items():
            key = node << 21 | c
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.next[at] = key, to

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next node, or 0 where there is none."""
        key = node.astype(np.int64) << 21 | letter
        at, out = self._slot(key), np.zeros(len(key), np.int32)
        left = np.arange(len(key))
        while len(left):
            held = self.keys[at[left]]
            hit = held == key[left]
            out[left[hit]] = self.next[at[left[hit]]]
            left = left[~hit & (held >= 0)]
            at[left] = (at[left] + 1) % len(self.keys)
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of each edge, in the order of end and word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        start = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rest = lengths[word] - start
        at = np.arange(len(letters))
        node = np.zeros(len(letters), np.int32)
        found = []
        for size in range(1, self.longest + 1):
            node = self._step(node, letters[at + size - 1])
            piece = self.piece[node]
            if size == 1:
                some, piece = at, np.where((node > 0) & (piece >= 0), piece, self.unknown)
            else:
                held = (node > 0) & (piece >= 0)
                some, piece = at[held], piece[held]
            found.append((word[some], start[some], start[some] + size, piece))
            live = (node > 0) & (rest[at] > size)
            at, node = at[live], node[live]
            if not len(at):
                break
        w, a, b, p = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(b * len(words) + w, kind="stable")
        return w[order], a[order], b[order], p[order]


def lattices(words: list[str], langs: int) -> Iterator[np.ndarray]:
    """The words, as places in the list, in groups of similar length and of bounded cells."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    a = 0
    while a < len(order):
        n = max(1, CELLS // (max(1, langs) * (int(lengths[order[a]]) + 1)))
        b = min(len(order), a + n)
        while b - a > 1 and (b - a) * (int(lengths[order[b - 1]]) + 1) * langs > 2 * CELLS:
            b = a + (b - a) // 2
        yield order[a:b]
        a = b


def _sweep(at: np.ndarray, scale: np.ndarray, word: np.ndarray, frm: np.ndarray, to: np.ndarray, weight: np.ndarray, back: int) -> None:
    """at[word, to] = sum of at[word, frm] * weight, for edges in the order in which `to` is final.
    What has become small is scaled: the true value is at * exp(scale). `back`: the places behind
    that an edge reaches, negative in a sweep from the end."""
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
    for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(to)], strict=True)):
        w = word[a:b]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        at[w[first], to[a]] = np.add.reduceat(at[w, frm[a:b]] * weight[a:b], first)
        scale[w[first], to[a]] = scale[w[first], to[a] - (1 if back > 0 else -1)]
        if i % STRIDE == STRIDE - 1:
            t = int(to[a])
            span = slice(max(0, t - back + 1), t + 1) if back > 0 else slice(t, t - back)
            rows = np.unique(w)
            part = at[rows, span]
            most = part.max(axis=1)
            most[most == 0] = 1
            at[rows, span] = part / most[:, None]
            scale[rows, span] += np.log(most)[:, None]


def _ahead(lengths: np.ndarray, edges: tuple, weight: np.ndarray, back: int) -> tuple[np.ndarray, np.ndarray]:
    word, start, end, _ = edges
    at = np.zeros((len(lengths), int(lengths.max(initial=0)) + 1, weight.shape[1]))
    scale = np.zeros_like(at)
    at[:, 0] = 1
    _sweep(at, scale, word, start, end, weight, back)
    return at, scale


def forward(segmenter: Segmenter, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, over all segmentations. p: piece by language."""
    out = np.zeros((len(words), p.shape[1]))
    for group in lattices(words, p.shape[1]):
        some = [words[i] for i in group]
        lengths, edges = np.fromiter(map(len, some), np.int64, len(some)), segmenter.edges(some)
        at, scale = _ahead(lengths, edges, p[edges[3]], segmenter.longest)
        rows = np.arange(len(some))
        out[group] = np.log(at[rows, lengths]) + scale[rows, lengths]
    return out


def fit(segmenter: Segmenter, counts: dict[str, Counter], rounds: int, smoothing: float) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities by language, from word counts by language."""
    langs, size = sorted(counts), segmenter.unknown + 1
    words = sorted({w for c in counts.values() for w in c})
    times = np.array([[counts[lang][w] for lang in langs] for w in words], float)
    p = np.full((size, len(langs)), 1 / size)
    groups = []
    for group in lattices(words, len(langs)):
        some = [words[i] for i in group]
        edges = segmenter.edges(some)
        groups.append((np.fromiter(map(len, some), np.int64, len(some)), times[group], edges, np.lexsort((edges[0], -edges[1]))))
    for _ in range(rounds):
        seen = np.zeros_like(p)
        for lengths, n, edges, back in groups:
            word, start, end, piece = edges
            rows, weight = np.arange(len(lengths)), p[piece]
            ahead, up = _ahead(lengths, edges, weight, segmenter.longest)
            behind, down = np.zeros_like(ahead), np.zeros_like(up)
            behind[rows, lengths] = 1
            _sweep(behind, down, word[back], end[back], start[back], weight[back], -segmenter.longest)
            total = np.log(ahead[rows, lengths]) + up[rows, lengths]
            part = np.exp(up[word, start] + down[word, end] - total[word])
            expected = ahead[word, start] * weight * behind[word, end] * part * n[word]
            for k in range(len(langs)):
                seen[:, k] += np.bincount(piece, expected[:, k], size)
        both = seen.sum(axis=1, keepdims=True) / seen.sum()
        p = (1 - smoothing) * seen / seen.sum(axis=0) + smoothing * (0.9 * both + 0.1 / size)
    return langs, p


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame, cfg: LanguageConfig) -> dict[str, Counter]:
    """Word counts by language of the documents to learn from."""
    rows = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    parts = 1_000_000
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(parts, -(-cfg.per_language * parts // n)))])
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(parts)) < rate[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(map(MARK.__add__, words_of(text)))
        for lang, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([*c], pa.string()), pa.array([*c.values()], pa.int64())], ["lang", "word", "n"])

    out: dict[str, Counter] = {}
    table = rows.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        out.setdefault(lang, Counter())[word] = n
    return out


class Known:
    """Log probabilities of words, kept in a worker process from task to task."""

    def __init__(self, segmenter: Segmenter, langs: list[str], p: np.ndarray) -> None:
        self.segmenter, self.langs, self.p = segmenter, langs, p
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(langs)))

    def of(self, docs: list[list[str]]) -> Iterator[np.ndarray]:
        """The rows of each document's words."""
        fresh = list(set().union(*docs) - self.known.keys())
        if len(self.known) + len(fresh) > CACHE:
            self.known, self.logs = {}, self.logs[:0]
            fresh = list(set().union(*docs))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        if fresh:
            self.logs = np.concatenate([self.logs, forward(self.segmenter, [MARK + w for w in fresh], self.p)])
        get = self.known.__getitem__
        for d in docs:
            yield self.logs[np.fromiter(map(get, d), np.int64, len(d))]


def predict(docs: DataFrame, segmenter: Segmenter, langs: list[str], p: np.ndarray, bound: int = 256 << 20) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document. What is broadcast is measured, and
    more than `bound` bytes of it is an error: it grows with vocabulary and languages only."""
    value = (segmenter, langs, p)
    shared = session_broadcast(docs.sparkSession, value, pickled_size(value), bound)
    name = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = process_state()
        if state.get("language", (None,))[0] != name:
            state["language"] = name, Known(*shared.value)
        known = state["language"][1]
        langs = known.langs
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                docs = [words_of(t) if langs else [] for t in part.column(2).to_pylist()]
                pred, scores = [], []
                for logs in known.of(docs):
                    if not len(logs):
                        pred.append("und")
                        scores.append(0.0)
                        continue
                    total = logs.sum(axis=0)
                    best = int(total.argmax())
                    pred.append(langs[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, cfg: LanguageConfig) -> DataFrame:
    """Learns from the documents that are not held out, and predicts all."""
    segmenter = Segmenter(vocabulary(cfg.vocabulary))
    counts = {lang: c for lang, c in word_counts(docs, cfg).items() if c}
    langs, p = fit(segmenter, counts, cfg.rounds, cfg.smoothing) if counts else ([], np.zeros((segmenter.unknown + 1, 0)))
    return predict(docs, segmenter, langs, p)
