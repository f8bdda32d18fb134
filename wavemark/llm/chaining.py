"""Operator 6: fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Seeds are the minimisers of a text: of every `window` neighbouring k-word shingles the one with the
least hash, so two texts that share `window + k - 1` words share a seed. Equal texts form a class
and are seeded once. Places that share a seed are its list, and lists are matched in three steps:

* A list of at most `few` texts matches all of them with each other, so whatever they share around
  it is found. In a longer list each text is matched with the first, its hub, and the one before.
* A seed that many texts hold says little, and two texts that share a passage of such seeds may have
  other hubs. So texts with seeds of long lists are read again, and pairs of such seeds, neighbours or
  `apart` and more words from each other, are listed. What holds but a phrase of the passage has no
  such pair. These lists are matched in the same way, long ones with their first text only.
* Windows of `least_words` words all of whose seeds have long lists have a list each, matched with
  its first text. So no text whose window stands word for word in another is left without a match on
  all of it, however common its parts are.

The hub need not be alike, nor hold as much. So lists of pairs that are still long are gone through
again when passages are known: members whose places passages join to each other, directly or by way
of others, need no more, and every place that is not joined to most of its list, a stray, is compared
with all of the list. What is compared are the words around it, as many as a passage has on either
side; two places go on to be chained and aligned if these share as many words as the least passage
must agree in, so many of them in one order, and if in either text a passage may run over the place:
from a shared word to a shared word, long enough, with enough shared, where the text beyond those words
counts as shared for as many again. The price is a list's strays times its members, in blocks in
memory, of which only what may hold a passage leaves the task.

Matches of two texts are by all places in one against the first place, and the place of the same
rank, in the other, so that words repeated over and over still chain. Within one text, a seed's place
is matched with the place before it and the first, if they are `least_words` apart.

No list stands whole in one task. A task that has more than `few` texts of a list matches them with
their own first text, and passes on that one alone, so the list of a seed that a third of all texts
hold has some entries for each task; windows are spread by their own words, and passed on likewise.

The matches of two texts are chained: in the order of one text, a Fenwick tree over the places in
the other holds the best chain that ends before each place, under a cost for every word skipped on
either side. A chain breaks where the cost of going on exceeds its worth. What is left in chains too
short to align, as where words repeat, is chained along diagonals. Chains are then aligned on
the words of both texts: between seeds and outward from both ends, counting words that agree. A
passage counts if it has `least_words` words on both sides and `identity` of them agree; a chain
that is long enough but too unlike is cut between seeds into the stretches that count.

Cases: null and empty texts have no seeds; a text shorter than a seed has none; very long texts have
as many as they need; copies are reported against their class's smallest doc_id, over the whole text
if that is long enough; a repeat inside one text is reported with the text as its own other; ties go
to the lesser key of a text; an id on several rows stands for each of its texts; rows without doc_id
are not reported; empty tables give an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import lt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, mix64, session_broadcast, slices, window_hashes, word_count, word_hashes, written  # noqa: F401
from .graph import FILTER_BITS, may_hold, membership, slot_of

#: A place of a seed, or of two, `gap` words apart. `long` marks what a task passes on for more texts
#: of its own.
SEED = np.dtype([("token", "<u8"), ("key", "<i8"), ("at", "<i4"), ("long", "u1")])
PAIR = np.dtype([("token", "<u8"), ("key", "<i8"), ("at", "<i4"), ("gap", "u1"), ("long", "u1")])
WINDOW = np.dtype([("token", "<u8"), ("key", "<i8"), ("at", "<i4")])
MATCH = np.dtype([("a", "<i8"), ("b", "<i8"), ("x", "<i4"), ("y", "<i4")])
ANCHOR = np.dtype([("x", "<i4"), ("y", "<i4")])
#: A stretch of a text that a passage joins to another; that two texts of a list are joined; a place
#: that is joined to few, by list and text.
COVER = np.dtype([("key", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("partner", "<i8")])
EDGE = np.dtype([("token", "<u8"), ("key", "<i8"), ("partner", "<i8")])
STRAY = np.dtype([("token", "<u8"), ("key", "<i8")])
STRETCH = np.dtype([*STRAY.descr, ("lo", "<i4"), ("at", "<i4"), ("cut", "u1")])
#: What a packed row holds: places of seeds, of pairs of seeds, of windows; matches of seeds, of
#: windows; seeds whose list is long, and the texts that hold them; pairs whose list is long; and of
#: these lists covers, edges, strays, lists with strays, the words around places.
SEEDS, PAIRS, WINDOWS, MATCHES, RUNS, COMMON, HOLDERS, LONG, COVERS, EDGES, STRAYS, OPEN, CONTEXTS = range(13)
PACKED = "kind int, shard int, data binary"
#: How many times more shards the places of long lists of pairs have than seeds; places that are
#: matched at a time.
FINER, AT_ONCE = 8, 50_000
#: Pairs of texts from which a word is counted by a product of matrices: there a pair costs as much.
OFTEN = 5_000
#: Words of two stretches up to which their order is compared.
IN_ORDER = 600
#: Bytes of texts that are hashed at a time, many small texts at once.
READ = 1 << 19
#: Bytes of a packed cell at most, where no shard divides them: thousands of cells are read at once.
#: Bytes of cells that are dealt to shards at a time.
CELL, DEALT = 4_000, 4 << 20


@dataclass(frozen=True)
class ChainingConfig:
    """k and window: seeds; skip: cost of a skipped word, in words; least_span: words that a chain
    must span between its seeds' ends to be aligned; margin: words kept around a chain; few: texts of a list that
    are all matched with each other; apart: least words between
    two common seeds, or they are neighbours; flush: places that a task holds at a time; inside: whether
    repeats inside one text are sought."""

    k: int = 5
    window: int = 10
    skip: float = 0.05
    least_seeds: int = 2
    least_span: int = 15
    margin: int = 100
    least_words: int = 50
    identity: float = 0.8
    shard_bytes: int = 24 << 20
    few: int = 12
    apart: int = 10
    flush: int = 1_000_000
    inside: bool = True


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _avalanche(h: np.ndarray, shift: int, prime: int, last: int) -> np.ndarray:
    h ^= h >> np.uint64(shift)
    h *= np.uint64(prime)
    h ^= h >> np.uint64(last)
    return h


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The two halves of each product of 128 bits, one xor the other."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    one, two = a1 * b0, a0 * b1
    middle = (a0 * b0 >> half) + (one & low) + (two & low)
    return (a * b) ^ (a1 * b1 + (one >> half) + (two >> half) + (middle >> half))


def _xxh3(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxh3_64 of pieces of the data, as word_hashes gives it; the data go on for 8 bytes at least after
    each start."""
    out = np.empty(len(start), np.uint64)
    at8, at4 = (np.ndarray(len(data) - n + 1, f"<u{n}", data, strides=(1,)) for n in (8, 4))
    bytes_ = np.frombuffer(data, np.uint8)
    i = np.flatnonzero(size <= 3)
    a, n = start[i], size[i]
    h = bytes_[a].astype(np.uint64) << np.uint64(16) | bytes_[a + (n >> 1)].astype(np.uint64) << np.uint64(24) | bytes_[a + n - 1].astype(np.uint64)
    h = (h | n.astype(np.uint64) << np.uint64(8)) ^ np.uint64(0x87275A9B)
    h = _avalanche(h, 33, 0xC2B2AE3D27D4EB4F, 29) * np.uint64(0x165667B19E3779F9)
    out[i] = h ^ (h >> np.uint64(32))
    i = np.flatnonzero((size > 3) & (size <= 8))
    a, n = start[i], size[i]
    h = (at4[a + n - 4].astype(np.uint64) + (at4[a].astype(np.uint64) << np.uint64(32))) ^ np.uint64(0xC73AB174C5ECD5A2)
    h ^= (h << np.uint64(49) | h >> np.uint64(15)) ^ (h << np.uint64(24) | h >> np.uint64(40))
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= (h >> np.uint64(35)) + n.astype(np.uint64)
    h *= np.uint64(0x9FB21C651E98DF25)
    out[i] = h ^ (h >> np.uint64(28))
    i = np.flatnonzero((size > 8) & (size <= 16))
    a, n = start[i], size[i]
    low, high = at8[a] ^ np.uint64(0x6782737BEA4239B9), at8[a + n - 8] ^ np.uint64(0xAF56BC3B0996523A)
    out[i] = _avalanche(n.astype(np.uint64) + low.byteswap() + high + _folded(low, high), 37, 0x165667919E3779F9, 32)
    for j in np.flatnonzero(size > 16).tolist():
        out[j] = xxhash.xxh3_64_intdigest(data[start[j] : start[j] + size[j]])
    return out


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def text_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, one text after the other, and where each text begins and
    the last ends: word_hashes(words_of(text)) for each."""
    data = b" ".join([*texts, bytes(8)]).lower()
    space = _SPACE[np.frombuffer(data, np.uint8, len(data) - 8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edges = np.concatenate([[0], edges])
    start = edges[::2]
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return _xxh3(data, start, edges[1::2] - start), np.searchsorted(start, begins)


def least_of(h: np.ndarray, window: int) -> np.ndarray:
    """Place of the first least of each `window` neighbours, of which there are as many at least."""
    n, least, off = 1, h, np.zeros(len(h), np.uint16)
    while n < window:
        step = min(n, window - n)
        right = least[step:] < least[:-step]
        off = np.where(right, off[step:] + np.uint16(step), off[:-step])
        least = np.minimum(least[step:], least[:-step])
        n += step
    return off + np.arange(len(off))


def distinct_texts(batches: Iterator[pa.RecordBatch], cfg: ChainingConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, hashes of words and bounds of the distinct texts of batches (key, text), READ bytes at a time."""
    seen: set[int] = set()
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if key in seen:
                continue
            seen.add(key)
            keys.append(key)
            texts.append(text.as_py())
            held += len(texts[-1])
            if held > min(READ, cfg.flush):
                yield np.array(keys, np.int64), *text_hashes(texts)
                keys, texts, held = [], [], 0
    if keys:
        yield np.array(keys, np.int64), *text_hashes(texts)


def seeds_of_all(keys: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, cfg: ChainingConfig) -> np.ndarray:
    """The seeds of several texts, one text after the other, given the hashes of their words."""
    size = np.diff(bounds)
    keys, first, size = keys[size >= cfg.k], bounds[:-1][size >= cfg.k], size[size >= cfg.k]
    if not len(keys):
        return np.zeros(0, SEED)
    # After each text's shingles come as many that are never the least.
    many = size - cfg.k + 1
    begin = np.cumsum(many + cfg.window) - many - cfg.window
    h = np.full(int((many + cfg.window).sum()), np.uint64(0xFFFFFFFFFFFFFFFF))
    h[within(begin, many)] = window_hashes(hashes, cfg.k)[within(first, many)]
    chosen = np.zeros(len(h), bool)
    chosen[least_of(h, cfg.window)[within(begin, np.maximum(1, many - cfg.window + 1))]] = True
    at = np.flatnonzero(chosen)
    text = np.searchsorted(begin, at, "right") - 1
    out = np.zeros(len(at), SEED)
    out["token"], out["key"], out["at"] = h[at], keys[text], at - begin[text]
    return out


def minimisers(hashes: np.ndarray, cfg: ChainingConfig) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the seeds of a text, given its words' hashes."""
    if len(hashes) < cfg.k:
        return hashes[:0], np.zeros(0, np.int64)
    h = window_hashes(hashes, cfg.k)
    if len(h) <= cfg.window:
        at = np.array([int(h.argmin())])
    else:
        at = np.unique(least_of(h, cfg.window))
    return h[at], at


def within(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ... of each of several runs, one run after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def long_windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n neighbouring word hashes, from running sums of powers."""
    if len(h) < n:
        return h[:0]
    base = 0x9E3779B97F4A7C15
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h) - 1, np.uint64(b))])) for b in (base, pow(base, -1, 1 << 64)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down)])
    return mix64((total[n:] - total[:-n]) * up[: len(h) - n + 1])


def pairs_of(e: np.ndarray, common: np.ndarray, cfg: ChainingConfig) -> np.ndarray:
    """Pairs of each text's seeds within least_words, of which one is common: all that are apart, and
    neighbours that both are. In a run of one seed, as of a word said over and over, a place has the
    pair of its seed with itself once, with its neighbour; and of a place's pairs with the places of a
    run, which are one pair, the shortest and the longest are kept."""
    out = []
    token, key, place = (np.ascontiguousarray(e[c]) for c in ("token", "key", "at"))
    runs = np.zeros(len(e), bool)
    runs[:-1] = (token[1:] == token[:-1]) & (key[1:] == key[:-1]) & (place[1:] - place[:-1] <= cfg.least_words - cfg.k)
    inner = runs.copy()
    inner[1:] &= runs[:-1]
    inner[:1] = False
    runs &= common
    after = np.append(place[1:], 0)
    for step in range(1, len(e)):
        gap = place[step:] - place[:-step]
        near = (gap <= cfg.least_words - cfg.k) & (key[step:] == key[:-step])
        if not near.any():
            break
        one, two = common[:-step], common[step:]
        fine = near & (((gap >= cfg.apart) & (one | two)) | (one & two & (step == 1)))
        if step > 1:
            fine &= ~(runs[:-step] & (token[step:] == token[:-step]))
            between = (place[step - 1 : -1] - place[:-step] >= cfg.apart) & (after[step:] - place[:-step] <= cfg.least_words - cfg.k)
            fine &= ~(inner[step:] & between)
        i = np.flatnonzero(fine)
        part = np.zeros(len(i), PAIR)
        part["token"] = mix64(token[i] ^ mix64(token[i + step]))
        part["key"], part["at"], part["gap"] = key[i], place[i], gap[i]
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, PAIR)


def met_again(e: np.ndarray) -> np.ndarray:
    """Whether each place's token is on another row too, or its list is long: the rest match nothing."""
    token = np.ascontiguousarray(e["token"])
    order = np.argsort(token)
    same = token[order[1:]] == token[order[:-1]]
    out = e["long"] > 0
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class Lists:
    """Places of several lists, in the order of list, text and place, copies taken away."""

    def __init__(self, e: np.ndarray) -> None:
        last = 1 - e["long"] if "long" in e.dtype.names else np.zeros(len(e), np.int8)
        e = e[np.lexsort((last, e["at"], e["key"], e["token"]))]
        new = np.ones(len(e), bool)
        new[1:] = e["token"][1:] != e["token"][:-1]
        text = new.copy()
        text[1:] |= e["key"][1:] != e["key"][:-1]
        once = text.copy()
        once[1:] |= e["at"][1:] != e["at"][:-1]
        self.e, new, text = e[once], new[once], text[once]
        #: Of each text of a list: its first place, its number of places, its list, its place there.
        self.start = np.flatnonzero(text)
        self.places = np.diff(np.append(self.start, len(self.e)))
        self.list = np.cumsum(new)[self.start] - 1 if len(self.e) else self.start
        self.first = np.flatnonzero(new[self.start]) if len(self.e) else self.start
        self.texts = np.diff(np.append(self.first, len(self.start)))
        self.rank = np.arange(len(self.start)) - self.first[self.list]

    def of_places(self, of_texts: np.ndarray) -> np.ndarray:
        return np.repeat(of_texts, self.places)

    def longer(self, few: int) -> np.ndarray:
        """Whether each list has more than `few` texts, here or in a task that passed one on."""
        out = self.texts > few
        if "long" in self.e.dtype.names and len(out):
            out |= np.maximum.reduceat(self.e["long"], self.start[self.first]) > 0
        return out

    def partners(self, all_of: np.ndarray, hub_of: np.ndarray, before: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Texts to match: all with all in some lists, each with the first and the one before in others."""
        t = np.arange(len(self.start))
        n = np.where(all_of[self.list], self.rank, 0)
        far = t[hub_of[self.list] & (self.rank > 0)]
        near = far[self.rank[far] > 1] if before else far[:0]
        return np.concatenate([np.repeat(t, n), far, near]), np.concatenate([within(self.first[self.list], n), self.first[self.list[far]], near - 1])

    def matches(self, one: np.ndarray, other: np.ndarray, gaps: bool = False) -> np.ndarray:
        n = self.places[one]
        x, y, rank = within(self.start[one], n), np.repeat(self.start[other], n), within(np.zeros(len(one), np.int64), n)
        again = (rank > 0) & (rank < np.repeat(self.places[other], n))
        return self._made(np.concatenate([x, x[again]]), np.concatenate([y, (y + rank)[again]]), gaps)

    def inside(self, apart: int) -> np.ndarray:
        """Matches of each text with itself."""
        own = self.of_places(self.start)
        i = np.flatnonzero(np.arange(len(self.e)) > own)
        x, y = np.concatenate([i, i]), np.concatenate([i - 1, own[i]])
        far = self.e["at"][x] - self.e["at"][y] >= apart
        return self._made(x[far], y[far], False)

    def _made(self, x: np.ndarray, y: np.ndarray, gaps: bool) -> np.ndarray:
        e = self.e
        out = np.empty(len(x), MATCH)
        out["a"], out["b"], out["x"], out["y"] = e["key"][x], e["key"][y], e["at"][x], e["at"][y]
        if gaps:
            more = out.copy()
            more["x"] += e["gap"][x]
            more["y"] += e["gap"][y]
            out = np.concatenate([out, more])
        return distinct(out)


class Sink:
    """Gathers arrays by kind and shard, and gives them as packed rows."""

    def __init__(self, shards: int) -> None:
        self.shards, self.rows = shards, []

    def add(self, kind: int, e: np.ndarray, shard: int | None = None, by: str = "token") -> None:
        """Rows go to the shard of their token, or of another field, or all to one."""
        if not len(e):
            return
        if shard is not None:
            n = CELL // e.itemsize
            self.rows += [(kind, shard % self.shards, e[i : i + n].tobytes()) for i in range(0, len(e), n)]
            return
        at = (mix64(np.ascontiguousarray(e[by]).view(np.uint64)) % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        e, at = e[order], at[order]
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        self.rows += [(kind, int(at[a]), e[a:b].tobytes()) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(e)], strict=True)]

    def columns(self) -> list[pa.Array]:
        rows, self.rows = self.rows, []
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.int32(), pa.int32(), pa.binary()), strict=True)]


def give_back() -> None:
    """What this process has freed goes back to the machine, since workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then what the task has freed is given back."""
    try:
        yield from batches
    finally:
        give_back()


def freeing(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same work on a group; then what it has freed is given back."""

    def run(rows: pa.Table) -> pa.Table:
        out = work(rows)
        give_back()
        return out

    return run


def unpacked(rows: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    found = [np.frombuffer(x, dtype) for k, x in zip(rows.column("kind").to_pylist(), rows.column("data").to_pylist(), strict=True) if k == kind]
    return np.concatenate(found) if found else np.zeros(0, dtype)


def run_ends(m: np.ndarray, far: int) -> np.ndarray:
    """Matches of the first and last seed's length of words of each run of windows on one diagonal."""
    m = m[np.lexsort((m["x"], m["x"] - m["y"], m["b"], m["a"]))]
    joint = np.zeros(len(m) + 1, bool)
    joint[1:-1] = (m["a"][1:] == m["a"][:-1]) & (m["b"][1:] == m["b"][:-1]) & (m["x"][1:] == m["x"][:-1] + 1) & (m["y"][1:] == m["y"][:-1] + 1)
    first, last = m[~joint[:-1]], m[~joint[1:]].copy()
    last["x"] += far
    last["y"] += far
    return np.concatenate([first, last])


def _rising_chains(x: list[int], y: list[int], cfg: ChainingConfig) -> list[list[int]]:
    """chains_of matches that rise in both: the best before each is the one just before it, since what
    ends there is worth a seed more than all before, wherever it began."""
    score, before, best = [], [], -1e18
    for i, (u, v) in enumerate(zip(x, y, strict=True)):
        cost = cfg.skip * (u + v)
        gain = best - cost
        score.append(cfg.k + gain if gain > 0 else float(cfg.k))
        before.append(gain > 0)
        best = score[-1] + cost
    ends, end = [], len(x)
    # From each first match of a run, up to the best end, then what is left of the run in the same way.
    for i in range(len(x) - 1, -1, -1):
        if not before[i]:
            a = i
            while a < end:
                m = max(range(a, end), key=lambda m: (score[m], -m))
                ends.append((a, m))
                a = m + 1
            end = i
    return [[*range(a, m + 1)] for a, m in sorted(ends, key=lambda e: (-score[e[1]], e[1]))]


def chains_of(x: list[int], y: list[int], cfg: ChainingConfig) -> list[list[int]]:
    """Chains of matches, best first, as rising indices; the matches come in the order of x, y.

    Within one x no match follows another, so all of an x are scored before any is entered.
    """
    n, worth = len(x), float(cfg.k)
    if n > 1 and all(map(lt, x, x[1:])) and all(map(lt, y, y[1:])):
        return _rising_chains(x, y, cfg)
    places, rank = np.unique(np.array(y), return_inverse=True)
    cost, rank, size = (cfg.skip * (np.array(x) + np.array(y))).tolist(), rank.tolist(), len(places)
    #: Of the Fenwick tree's nodes: the best value, and the last match that has it.
    value, last = [-1e18] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j, at = i, x[i]
        while j < n and x[j] == at:
            k, best, m = rank[j], -1e18, -1
            while k:
                v = value[k]
                if v > best or (v == best and last[k] > m):
                    best, m = v, last[k]
                k &= k - 1
            gain = best - cost[j]
            if gain > 0:
                score[j], before[j] = worth + gain, m
            else:
                score[j] = worth
            j += 1
        for m in range(i, j):
            v, k = score[m] + cost[m], rank[m] + 1
            while k <= size:
                # Matches come in rising order, so of equal values this is the last.
                if v >= value[k]:
                    value[k], last[k] = v, m
                k += k & -k
        i = j
    used, out = [False] * n, []
    for m in sorted(range(n), key=score.__getitem__, reverse=True):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(m)
            m = before[m]
        if chain:
            out.append(chain[::-1])
    return out


def diagonal_chains(x: np.ndarray, y: np.ndarray, cfg: ChainingConfig) -> list[np.ndarray]:
    """Matches that follow each other on one diagonal, as rising indices, longest first; of those
    that share more than half their words in x, the first."""
    order = np.lexsort((x, y - x))
    d, at = (y - x)[order], x[order]
    out, taken = [], []
    first = np.concatenate([[0], np.flatnonzero((d[1:] != d[:-1]) | (at[1:] - at[:-1] > cfg.least_words)) + 1])
    stop = np.append(first[1:], len(order))
    fine = (stop - first >= cfg.least_seeds) & (at[stop - 1] + cfg.k - at[first] >= cfg.least_span)
    first, stop = first[fine], stop[fine]
    longest = np.argsort(at[first] - at[stop - 1], kind="stable")
    for i, j in zip(first[longest].tolist(), stop[longest].tolist(), strict=True):
        a, b = int(at[i]), int(at[j - 1]) + cfg.k
        if all(2 * (min(b, v) - max(a, u)) <= b - a for u, v in taken):
            taken.append((a, b))
            out.append(order[i:j])
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by rows."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    row = np.zeros(len(b) + 1, np.int32)
    for word in a:
        up = np.append(0, np.where(b == word, row[:-1] + 1, row[1:]))
        row = np.maximum.accumulate(np.maximum(up, row))
    return int(row[-1])


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words to take from the starts of both, and how many agree, while the agreement pays: 1 for
    an equal word and -2 for another."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -2))
    best = int(total.argmax())
    return (best + 1, int(same[: best + 1].sum())) if total[best] > 0 else (0, 0)


def agreement(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds that add words to those before them, and how many words agree up to the end of each."""
    kept, total, agree, cx, cy = [], [], 0, int(x[0]), int(y[0])
    same = np.diff(x) == np.diff(y)
    turns = [*(np.flatnonzero(~same) + 1).tolist(), len(x)]
    i = turn = 0
    while i < len(x):
        while turns[turn] <= i:
            turn += 1
        sx, sy, i = int(x[i]), int(y[i]), i + 1
        new = k
        if sx < cx or sy < cy:  # overlaps the seed before: only what is new on both sides counts
            step = max(cx - sx, cy - sy)
            sx, sy, new = sx + step, sy + step, k - step
        if new <= 0:
            continue
        if sx > cx and sy > cy:
            gap_a, gap_b = a[cx:sx], b[cy:sy]
            agree += int((gap_a == gap_b).sum()) if len(gap_a) == len(gap_b) else common_words(gap_a, gap_b)
        agree += new
        cx, cy = sx + new, sy + new
        kept.append(i - 1)
        total.append(agree)
        j = turns[turn]
        if i < j:  # the seeds that follow on the same diagonal
            stop = int(x[j - 1]) + k
            equal = np.cumsum(a[cx:stop] == b[cy : cy + stop - cx])
            kept += range(i, j)
            total += (agree + equal[x[i:j] + k - cx - 1]).tolist()
            agree, cx, cy, i = total[-1], stop, cy + stop - cx, j
    return np.array(kept), np.array(total)


def _spread(a: np.ndarray, b: np.ndarray, x0: int, x1: int, y0: int, y1: int, agree: int) -> tuple[int, int, int, int, int]:
    left, left_same = extend(a[:x0][::-1], b[:y0][::-1])
    right, right_same = extend(a[x1:], b[y1:])
    return x0 - left, x1 + right, y0 - left, y1 + right, agree + left_same + right_same


def aligned(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[int, int, int, int, int]:
    """Start and stop in a, start and stop in b, and the words that agree, along a chain of seeds
    at x and y."""
    kept, total = agreement(a, b, x, y, k)
    return _spread(a, b, int(x[0]), int(x[kept[-1]]) + k, int(y[0]), int(y[kept[-1]]) + k, int(total[-1]))


def passages(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, cfg: ChainingConfig) -> list[tuple[int, int, int, int, int]]:
    """What is long and alike enough along a chain: all of it, or else the stretch from seed to seed
    in which most words agree, and then the same of what is left before and after that."""
    kept, total = agreement(a, b, x, y, cfg.k)
    x, y, k = x[kept].astype(np.int64), y[kept].astype(np.int64), cfg.k
    whole = _spread(a, b, int(x[0]), int(x[-1]) + k, int(y[0]), int(y[-1]) + k, int(total[-1]))
    if min(whole[1] - whole[0], whole[3] - whole[2]) < cfg.least_words:
        return []
    if whole[4] >= cfg.identity * max(whole[1] - whole[0], whole[3] - whole[2]):
        return [whole]
    # A stretch that ends where the next step agrees in every word is never the best.
    steps = np.diff(total)
    rough = (steps != np.diff(x)) | (steps != np.diff(y))
    out, rest = [], [(0, len(x), 0, len(a), 0, len(b))]
    while rest:
        i0, i1, a0, a1, b0, b1 = rest.pop()
        if i0 >= i1 or min(a1 - a0, b1 - b0) < cfg.least_words:
            continue
        first = np.concatenate([[i0], i0 + 1 + np.flatnonzero(rough[i0 : i1 - 1])])
        last = np.concatenate([i0 + np.flatnonzero(rough[i0 : i1 - 1]), [i1 - 1]])
        m = cfg.margin
        left = [extend(a[max(a0, x[i] - m) : x[i]][::-1], b[max(b0, y[i] - m) : y[i]][::-1]) for i in first]
        right = np.array([extend(a[x[j] + k : min(a1, x[j] + k + m)], b[y[j] + k : min(b1, y[j] + k + m)]) for j in last])
        best = (-1, 0, 0, 0, 0)
        for n, (i, (more, same)) in enumerate(zip(first.tolist(), left, strict=True)):
            j = last[n:]
            xs, ys = x[j] + k - x[i] + more + right[n:, 0], y[j] + k - y[i] + more + right[n:, 0]
            agree = total[j] - total[i] + k + same + right[n:, 1]
            agree = np.where((np.minimum(xs, ys) >= cfg.least_words) & (agree >= cfg.identity * np.maximum(xs, ys)), agree, -1)
            at = int(agree.argmax())
            if agree[at] > best[0]:
                best = (int(agree[at]), i, int(j[at]), more, int(right[n + at, 0]))
        agree, i, j, more, after = best
        if agree < 0:
            continue
        x0, x1, y0, y1 = int(x[i]) - more, int(x[j]) + k + after, int(y[i]) - more, int(y[j]) + k + after
        out.append((x0, x1, y0, y1, agree))
        before = i0 + int(((x[i0:i] + k <= x0) & (y[i0:i] + k <= y0)).sum())
        beyond = i1 - int(((x[j + 1 : i1] >= x1) & (y[j + 1 : i1] >= y1)).sum())
        rest += [(i0, before, a0, x0, b0, y0), (beyond, i1, x1, a1, y1, b1)]
    return sorted(out)


def _seeds(docs: DataFrame, cfg: ChainingConfig, shards: int) -> DataFrame:
    """Packed places of the seeds, and what a task has matched itself; `at` is the shard of this
    step. A task seeds each distinct text once, many at a time."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spread, sink = TaskContext.get().partitionId(), Sink(shards)

        def spill(rows: list[np.ndarray]) -> pa.RecordBatch:
            e = np.concatenate(rows)
            again = met_again(e)
            lists = Lists(e[again])
            sink.add(SEEDS, e[~again])
            long = lists.longer(cfg.few)
            sink.add(MATCHES, lists.matches(*lists.partners(long & False, long)), spread)
            if cfg.inside:
                sink.add(MATCHES, lists.inside(cfg.least_words), spread)
            held = lists.of_places(long[lists.list])
            sink.add(COMMON, np.unique(lists.e["token"][held]), spread)
            sink.add(HOLDERS, np.unique(lists.e["key"][held]), spread)
            e = lists.e.copy()
            e["long"] |= held
            sink.add(SEEDS, e[~held | lists.of_places(lists.rank == 0)])
            columns = sink.columns()
            at = np.where(columns[0].to_numpy() == SEEDS, columns[1].to_numpy(), spread % shards).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(at), *columns], ["at", "kind", "shard", "data"])

        rows, held = [], 0
        for texts in distinct_texts(batches, cfg):
            rows.append(seeds_of_all(*texts, cfg))
            held += len(rows[-1])
            if held > cfg.flush:
                yield spill(rows)
                rows, held = [], 0
        if held:
            yield spill(rows)

    return docs.select("key", "text").mapInArrow(lambda batches: given_back(deal(batches)), f"at int, {PACKED}")


def _lists(seeds: DataFrame, cfg: ChainingConfig, shards: int) -> DataFrame:
    """Matches of the lists of seeds, the seeds of long ones, and the texts that hold these."""

    def meet(rows: pa.Table) -> pa.Table:
        sink, spread = Sink(shards), rows.column("at")[0].as_py()
        e = unpacked(rows, SEEDS, SEED)
        if len(e):
            lists = Lists(e[met_again(e)])
            long = lists.longer(cfg.few)
            sink.add(MATCHES, lists.matches(*lists.partners(~long, long)), spread)
            held = lists.of_places(long[lists.list])
            sink.add(COMMON, np.unique(lists.e["token"][held]), spread)
            sink.add(HOLDERS, np.unique(lists.e["key"][held]), spread)
        made = pa.table(sink.columns(), ["kind", "shard", "data"])
        return pa.concat_tables([made, rows.select(["kind", "shard", "data"]).filter(pc.not_equal(rows.column("kind"), SEEDS)).cast(made.schema)])

    return seeds.groupBy("at").applyInArrow(freeing(meet), PACKED)


def _numbers(packed: DataFrame, kind: int) -> DataFrame:
    """(number) of the packed numbers of a kind."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, np.int64))], ["number"])

    return packed.filter(F.col("kind") == kind).select("data").mapInArrow(flat, "number long")


def common_windows(keys: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, e: np.ndarray, common: np.ndarray, cfg: ChainingConfig) -> np.ndarray:
    """The windows of least_words words of several texts in which all seeds e, as the window's own
    words tell them, are common."""
    least, reach = cfg.least_words, cfg.least_words - (cfg.k + cfg.window - 1)
    many = np.maximum(0, np.diff(bounds) - least + 1)
    if not many.any() or not common.any() or reach < 0:
        return np.zeros(0, WINDOW)
    place, text = within(bounds[:-1], many), np.repeat(np.arange(len(keys)), many)
    rare = np.concatenate([[0], np.cumsum(~common)])
    size = np.bincount(np.cumsum(np.diff(e["key"], prepend=e["key"][0]) != 0))
    seeded = np.flatnonzero(np.diff(bounds) >= cfg.k)
    chosen = least_of(window_hashes(hashes, cfg.k), cfg.window)
    at = np.repeat(bounds[seeded], size) + e["at"]
    fine = rare[np.searchsorted(at, chosen[place + reach]) + 1] == rare[np.searchsorted(at, chosen[place])]
    place, text = place[fine], text[fine]
    out = np.empty(len(place), WINDOW)
    if len(place):
        out["token"], out["key"], out["at"] = long_windows(hashes, least)[place], keys[text], place - bounds[text]
    return out


def _filter(spark: SparkSession, numbers: DataFrame):
    """A broadcast filter of fixed size that tells numbers that are not there."""
    bits = membership(numbers, "number", True)
    return session_broadcast(spark, bits, bits.nbytes, 1 << 23)


def _held(batches: Iterator[pa.RecordBatch], tokens: np.ndarray, keys: np.ndarray, cfg: ChainingConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, hashes of words, bounds, seeds, whether these are common) of the distinct texts that may
    hold common seeds, many at a time."""
    likely = (batch.filter(pa.array(may_hold(keys, batch.column(0).to_numpy() & (FILTER_BITS - 1)))) for batch in batches)
    for texts in distinct_texts(likely, cfg):
        e = seeds_of_all(*texts, cfg)
        if len(e):
            yield *texts, e, may_hold(tokens, (e["token"] & np.uint64(FILTER_BITS - 1)).astype(np.int64))


def _common(docs: DataFrame, tokens, keys, cfg: ChainingConfig, shards: int) -> DataFrame:
    """Matches of pairs and windows of common seeds, and pairs whose list is long. Texts without such
    seeds are told by a filter and not read again."""
    far = cfg.least_words - cfg.k

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spread, sink = TaskContext.get().partitionId(), Sink(shards)

        def spill(windows: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
            lists = Lists(np.concatenate(windows))
            every = np.ones(len(lists.texts), bool)
            sink.add(MATCHES, run_ends(lists.matches(*lists.partners(~every, every, False)), far), spread)
            sink.add(WINDOWS, lists.e[lists.of_places(lists.rank == 0)])
            e = np.concatenate(pairs)
            again = met_again(e)
            lists = Lists(e[again])
            sink.add(PAIRS, e[~again])
            long = lists.longer(cfg.few)
            sink.add(MATCHES, lists.matches(*lists.partners(long & False, long, False)), spread)
            held = lists.of_places(long[lists.list])
            e = lists.e.copy()
            e["long"] |= held
            sink.add(PAIRS, e[~held | lists.of_places(lists.rank == 0)])
            columns = sink.columns()
            at = np.where(columns[0].to_numpy() == MATCHES, spread % shards, columns[1].to_numpy()).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(at), *columns], ["at", "kind", "shard", "data"])

        windows, pairs, held = [], [], 0
        for *texts, e, known in _held(batches, tokens.value, keys.value, cfg):
            windows.append(common_windows(*texts, e, known, cfg))
            pairs.append(pairs_of(e, known, cfg))
            held += len(windows[-1]) + len(pairs[-1])
            if held > cfg.flush:
                yield spill(windows, pairs)
                windows, pairs, held = [], [], 0
        if held:
            yield spill(windows, pairs)

    def meet(rows: pa.Table) -> pa.Table:
        sink, spread = Sink(shards), rows.column("at")[0].as_py()
        e = unpacked(rows, WINDOWS, WINDOW)
        if len(e):
            lists = Lists(e)
            every = np.ones(len(lists.texts), bool)
            sink.add(RUNS, lists.matches(*lists.partners(~every, every, False)), spread)
        e = unpacked(rows, PAIRS, PAIR)
        if len(e):
            lists = Lists(e[met_again(e)])
            long = lists.longer(cfg.few)
            sink.add(MATCHES, lists.matches(*lists.partners(~long, long & False), gaps=True), spread)
            sink.add(MATCHES, lists.matches(*lists.partners(long & False, long, False)), spread)
            sink.add(LONG, lists.e["token"][lists.start[lists.first[long]]], spread)
        made = pa.table(sink.columns(), ["kind", "shard", "data"])
        return pa.concat_tables([made, rows.select(["kind", "shard", "data"]).filter(pc.equal(rows.column("kind"), MATCHES)).cast(made.schema)])

    return docs.select("key", "text").mapInArrow(lambda batches: given_back(deal(batches)), f"at int, {PACKED}").groupBy("at").applyInArrow(freeing(meet), PACKED)


def distinct(e: np.ndarray) -> np.ndarray:
    """The distinct rows, in the order of their fields."""
    e = e[np.lexsort([e[c] for c in e.dtype.names[::-1]])]
    new = np.ones(len(e), bool)
    if len(e):
        new[1:] = np.any([e[c][1:] != e[c][:-1] for c in e.dtype.names], axis=0)
    return e[new]


def node(token: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number for a text in a list."""
    return mix64(token ^ mix64(np.ascontiguousarray(key).view(np.uint64)))


def strays(edges: np.ndarray, few: int) -> np.ndarray:
    """Of each list with more than `few` texts, those that edges do not join to most of it. Each text
    has an edge to itself."""
    own = distinct(edges[edges["key"] == edges["partner"]][["token", "key"]].astype(STRAY))
    one, two = node(edges["token"], edges["key"]), node(edges["token"], edges["partner"])
    nodes, at = np.unique(np.concatenate([one, two]), return_inverse=True)
    one, two = at[: len(edges)], at[len(edges) :]
    one, two = one[one != two], two[one != two]
    low = np.arange(len(nodes))
    while True:
        near = low.copy()
        np.minimum.at(near, one, low[two])
        np.minimum.at(near, two, near[one])
        near = near[near]
        if (near == low).all():
            break
        low = near
    group = low[np.searchsorted(nodes, node(own["token"], own["key"]))]
    new = np.concatenate([[True], own["token"][1:] != own["token"][:-1]]) if len(own) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(own)))
    # A group lies in one list, so how many of a list's texts are in it is its number of texts.
    times = np.bincount(group, minlength=len(nodes))
    found = np.zeros(len(own), bool)
    for i, n in zip(first[size > few].tolist(), size[size > few].tolist(), strict=True):
        g = group[i : i + n]
        found[i : i + n] = g != g[times[g].argmax()]
    return own[found]


def bags_of(hashes: np.ndarray, e: np.ndarray, cfg: ChainingConfig) -> np.ndarray:
    """The words around a text's places in each list, in their order: places whose words overlap make one
    stretch, from `lo`, in one or more rows from `at`; `cut` has 1 if the text has words before it, 2 if after."""
    reach, width = cfg.least_words, 3 * cfg.least_words
    e = e[np.lexsort((e["at"], e["token"]))]
    token = np.ascontiguousarray(e["token"])
    owner = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
    lo = np.maximum(e["at"].astype(np.int64) - reach, 0)
    hi = np.minimum(e["at"].astype(np.int64) + e["gap"] + cfg.k + reach, len(hashes))
    # The end of all places of the list up to each; a list's numbers are above those of the one before.
    far = np.maximum.accumulate(owner * (len(hashes) + 1) + hi) - owner * (len(hashes) + 1)
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (lo[1:] > far[:-1])]))
    lo, hi, token = lo[first], far[np.append(first[1:], len(e)) - 1], token[first]
    rows = -(-(hi - lo) // width)
    out = np.zeros(int(rows.sum()), np.dtype([*STRETCH.descr, ("words", "<u4", (width,))]))
    out["token"], out["key"], out["lo"] = np.repeat(token, rows), e["key"][0], np.repeat(lo, rows)
    out["cut"] = np.repeat((lo > 0) + 2 * (hi < len(hashes)), rows)
    out["at"] = within(np.zeros(len(rows), np.int64), rows) * width + out["lo"]
    words = np.concatenate([np.maximum(hashes.astype(np.uint32), 1), np.zeros(width, np.uint32)])
    out["words"] = words[out["at"][:, None] + np.arange(width)]
    out["words"][np.arange(width) >= (np.repeat(hi, rows) - out["at"])[:, None]] = 0
    return out


def numbered(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Owner and number, in the order of numbers, of each word, told apart from its earlier ones of
    the owner, that several owners hold, and how many numbers there are. 0 is no word."""
    row, at = np.nonzero(words)
    owner, word = owner[row], words[row, at]
    order = np.lexsort((word, owner))
    owner, word = owner[order], word[order]
    begin = np.ones(len(word), bool)
    begin[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
    again = np.arange(len(word)) - np.maximum.accumulate(np.where(begin, np.arange(len(word)), 0))
    _, number, times = np.unique(word.astype(np.uint64) << np.uint64(32) | again.astype(np.uint64), return_inverse=True, return_counts=True)
    fine = times > 1
    owner, number = owner[fine[number]], (np.cumsum(fine) - 1)[number[fine[number]]]
    order = np.argsort(number, kind="stable")
    return owner[order], number[order], int(fine.sum())


def alike(words: np.ndarray, owner: np.ndarray, stray: np.ndarray, least: int, block: int = 1_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owners of rows of words, of which one is a stray, that share `least` words, block by block; the
    rows come in the order of owners."""
    start = np.searchsorted(owner, np.arange(len(stray) + 1))
    rows = np.diff(start)
    left, rest = ([x[i : i + block] for i in range(0, len(x), block)] for x in (np.flatnonzero(stray), np.flatnonzero(~stray)))
    for i, one in enumerate(left):
        for j, two in enumerate(left[: i + 1] + rest):
            both = np.concatenate([one, two])
            row, number, many = numbered(words[within(start[both], rows[both])], np.repeat(np.arange(len(both)), rows[both]))
            here, there = row < len(one), row >= len(one)
            a, wa, b, wb = row[here], number[here], row[there] - len(one), number[there]
            na, nb = np.bincount(wa, minlength=many), np.bincount(wb, minlength=many)
            often = na * nb > OFTEN
            # Words that many hold by a product of matrices, the rest by the pairs of their holders.
            few = wa[~often[wa]]
            x = np.repeat(a[~often[wa]], nb[few])
            y = b[within((np.cumsum(nb) - nb)[few], nb[few])]
            shared = np.bincount(x * len(two) + y, minlength=len(one) * len(two)).astype(np.float32).reshape(len(one), len(two))
            for some in np.array_split(np.flatnonzero(often), int(often.sum()) // 1_000 + 1):
                column = np.full(many, -1)
                column[some] = np.arange(len(some))
                left_, right_ = np.zeros((len(one), len(some)), np.float32), np.zeros((len(two), len(some)), np.float32)
                for held, r, w in ((left_, a, column[wa]), (right_, b, column[wb])):
                    held[r[w >= 0], w[w >= 0]] = 1
                shared += left_ @ right_.T
            a, b = np.nonzero(shared >= least)
            a, b = one[a], two[b]
            # Two blocks of strays meet once, for both.
            yield (np.concatenate([a, b]), np.concatenate([b, a])) if j < i else (a, b)


def dense(held: np.ndarray, size: np.ndarray, cut: np.ndarray, cfg: ChainingConfig) -> np.ndarray:
    """Whether a passage may run over the places of each stretch, a row, given which of its words the
    other text has: from a held word to a held word, least_words at least, enough of them held. Where the
    text goes on beyond the stretch, as many words as it has around a place count as held."""
    least, (n, width) = cfg.least_words, held.shape
    at, size, cut = np.arange(width + 2 * least), size[:, None], cut[:, None]
    every = np.zeros((n, width + 2 * least), bool)
    every[:, least:-least] = held
    every[:, :least] = cut & 1
    every |= (at >= least + size) & (at < 2 * least + size) & (cut > 1)
    worth = np.cumsum(every - np.float32(cfg.identity), axis=1, dtype=np.float32)
    # A sum up to a word is compared with sums before words least - 1 and more ahead of it.
    begin = np.where(every & ((at < size) | (cut < 2)), worth - np.float32(1 - cfg.identity), np.inf)
    end = np.where(every & ((at >= 2 * least) | (cut & 1 == 0)), worth, -np.inf)
    return (end[:, least - 1 :] >= np.minimum.accumulate(begin[:, : width + least + 1], axis=1) - 1e-3).any(axis=1)


def in_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit a word of b."""
    at: dict[int, int] = {}
    for i, word in enumerate(b):
        at[word] = at.get(word, 0) | 1 << i
    full = (1 << len(b)) - 1
    left = full
    for word in a:
        both = left & at.get(word, 0)
        left = ((left + both) | (left - both)) & full
    return len(b) - left.bit_count()


def passable(words: np.ndarray, cut: np.ndarray, owner: np.ndarray, x: np.ndarray, y: np.ndarray, cfg: ChainingConfig) -> np.ndarray:
    """Whether two owners' words, in their order, may hold a passage: in both, words that the other has
    too make a dense stretch, and as many as the least passage needs follow each other in one order.
    The rows come in the order of owners and words."""
    out, least = np.zeros(len(x), bool), int(np.ceil(cfg.identity * cfg.least_words))
    ids = np.unique(np.concatenate([x, y]))
    start, stop = np.searchsorted(owner, ids), np.searchsorted(owner, ids, "right")
    x, y, rows = np.searchsorted(ids, x), np.searchsorted(ids, y), stop - start
    # Pairs of one number of rows at a time, so that few long stretches do not make all wide.
    most = np.maximum(rows[x], rows[y])
    for many in np.unique(most).tolist():
        pairs = np.flatnonzero(most == many)
        pairs = pairs[np.argsort(x[pairs], kind="stable")]
        used = np.unique(np.concatenate([x[pairs], y[pairs]]))
        flat = np.zeros((len(used), many, words.shape[1]), np.uint32)
        flat[np.repeat(np.arange(len(used)), rows[used]), within(np.zeros(len(used), np.int64), rows[used])] = words[within(start[used], rows[used])]
        names, flat = np.unique(flat, return_inverse=True)
        flat = flat.reshape(len(used), -1)
        # Number 0 is no word: it fills up rows.
        if names[0]:
            names, flat = np.append(np.uint32(0), names), flat + 1
        size, ends = (flat > 0).sum(axis=1), cut[start[used]].astype(np.int64)
        one, two = np.searchsorted(used, x[pairs]), np.searchsorted(used, y[pairs])
        marks, step = np.zeros(len(names), bool), max(1, 1_000_000 // flat.shape[1])
        for n in range(0, len(pairs), step):
            u, v = one[n : n + step], two[n : n + step]
            held = np.zeros((len(u), flat.shape[1]), bool)
            first = np.flatnonzero(np.diff(u, prepend=-1))
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(u)], strict=True):
                marks[flat[u[i]]] = True
                marks[0] = False
                held[i:j] = marks[flat[v[i:j]]]
                marks[flat[u[i]]] = False
            left = np.flatnonzero(dense(held, size[v], ends[v], cfg))
            in_two, held = held[left], np.zeros((len(left), flat.shape[1]), bool)
            for i, (a, b) in enumerate(zip(flat[u[left]], flat[v[left]], strict=True)):
                marks[b] = True
                marks[0] = False
                held[i] = marks[a]
                marks[b] = False
            for i in np.flatnonzero(dense(held, size[u[left]], ends[u[left]], cfg)).tolist():
                a, b = flat[u[left[i]]][held[i]], flat[v[left[i]]][in_two[i]]
                # Long stretches have so many words in one order, as good as always.
                out[pairs[n + left[i]]] = max(len(a), len(b)) > IN_ORDER or in_order(a.tolist(), b.tolist()) >= least
    return out


def _strays(docs: DataFrame, tokens, keys, lists: DataFrame, found: DataFrame, cfg: ChainingConfig, shards: int) -> DataFrame | None:
    """Matches of the strays of long lists of pairs with all of their lists, given the passages
    found; None if there are no strays. `lists`: the pairs whose list is long."""
    wanted = _filter(docs.sparkSession, lists)
    texts = docs.select("key", "text")

    def chosen(batches: Iterator[pa.RecordBatch], marks: np.ndarray, holders: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for *texts, e, known in _held(batches, tokens.value, holders, cfg):
            e = pairs_of(e, known, cfg)
            e = e[may_hold(marks, (e["token"] & np.uint64(FILTER_BITS - 1)).astype(np.int64))]
            if len(e):
                yield *texts, e

    def around(batches: Iterator[pa.RecordBatch], marks: np.ndarray, holders: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for keys, hashes, bounds, e in chosen(batches, marks, holders):
            yield PAIRS, e
            e = e[np.argsort(e["key"], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]]))
            text = {key: i for i, key in enumerate(keys.tolist())}
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(e)], strict=True):
                i = text[int(e["key"][a])]
                yield CONTEXTS, bags_of(hashes[bounds[i] : bounds[i + 1]], e[a:b], cfg)

    def packed(parts: Iterator[tuple[int, np.ndarray]], by: str) -> Iterator[pa.RecordBatch]:
        sink, rows, held = Sink(shards), {}, 0

        def full() -> pa.RecordBatch:
            for kind in [*rows]:
                sink.add(kind, np.concatenate(rows.pop(kind)), by=by)
            return pa.RecordBatch.from_arrays(sink.columns(), ["kind", "shard", "data"])

        for kind, part in parts:
            rows.setdefault(kind, []).append(part)
            held += part.nbytes
            if held > cfg.shard_bytes // 2:
                yield full()
                held = 0
        if held:
            yield full()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(((PAIRS, e) for *_, e in chosen(batches, wanted.value, keys.value)), "key")

    def covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(batch: pa.RecordBatch) -> tuple[int, np.ndarray]:
            out = np.empty(batch.num_rows, COVER)
            for name, column in zip(COVER.names, batch.columns, strict=True):
                out[name] = column.to_numpy()
            return COVERS, out

        yield from packed(map(part, batches), "key")

    def join(rows: pa.Table) -> pa.Table:
        """Edges of the places of a text with itself and with the texts that passages over them join."""
        sink, e, c = Sink(shards), unpacked(rows, PAIRS, PAIR), unpacked(rows, COVERS, COVER)
        e, c = e[np.argsort(e["key"], kind="stable")], c[np.argsort(c["key"], kind="stable")]
        own = np.empty(len(e), EDGE)
        own["token"], own["key"], own["partner"] = e["token"], e["key"], e["key"]
        out, ids = [own], np.unique(c["key"])
        for a, b, i, j in zip(*(np.searchsorted(v["key"], ids, side).tolist() for v in (e, c) for side in ("left", "right")), strict=True):
            # Many passages over a place may join the same two texts.
            step = max(1, min(1_000, 1_000_000 // max(1, j - i)))
            for n in range(a, b, step):
                some, over = e[n : min(b, n + step)], c[i:j]
                x, y = np.nonzero((some["at"][:, None] >= over["lo"]) & (some["at"][:, None] + some["gap"][:, None] + cfg.k <= over["hi"]))
                edge = own[n + x]
                edge["partner"] = over["partner"][y]
                out.append(distinct(edge))
        sink.add(EDGES, distinct(np.concatenate(out)))
        return pa.table(sink.columns(), ["kind", "shard", "data"])

    def find(rows: pa.Table) -> pa.Table:
        sink, edges = Sink(shards), unpacked(rows, EDGES, EDGE)
        lone = strays(edges, cfg.few)
        sink.add(STRAYS, lone)
        sink.add(HOLDERS, np.unique(edges["key"][np.isin(edges["token"], lone["token"])]), 0)
        sink.add(OPEN, np.unique(lone["token"]), 0)
        return pa.table(sink.columns(), ["kind", "shard", "data"])

    over = found.filter("a <> b").select(F.col("a").alias("key"), F.col("start").cast("int").alias("lo"), F.col("stop").cast("int").alias("hi"), F.col("b").alias("partner"))
    edges = texts.mapInArrow(lambda batches: given_back(places(batches)), PACKED).unionByName(over.mapInArrow(lambda batches: given_back(covers(batches)), PACKED)).groupBy("shard").applyInArrow(freeing(join), PACKED)
    lone = written(edges.groupBy("shard").applyInArrow(freeing(find), PACKED), "chain-strays")
    if not lone.take(1):
        return None
    open_, members = _filter(docs.sparkSession, _numbers(lone, OPEN)), _filter(docs.sparkSession, _numbers(lone, HOLDERS).distinct())
    bag = np.dtype([*STRETCH.descr, ("words", "<u4", (3 * cfg.least_words,))])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(around(batches, open_.value, members.value), "token")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, spread, parts = Sink(shards), 0, {kind: [np.zeros(0, dtype)] for kind, dtype in ((STRAYS, STRAY), (PAIRS, PAIR), (CONTEXTS, bag))}
        for batch in batches:
            for kind, spread, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                parts[kind].append(np.frombuffer(data.as_buffer(), parts[kind][0].dtype))
        batch = data = None
        # Of all arrays, the words around places alone are large: they are copied once, in order.
        lone, e = (np.concatenate(parts.pop(kind)) for kind in (STRAYS, PAIRS))
        lists = Lists(e[np.isin(e["token"], lone["token"])])
        found = parts.pop(CONTEXTS)
        names = np.concatenate([x[["token", "key", "at"]].astype(WINDOW) for x in found])
        order = np.lexsort((names["at"], names["key"], names["token"]))
        # Copies of a text in several tasks gave the same rows.
        once = np.append(True, names[order[1:]] != names[order[:-1]])[: len(order)]
        order = order[once & np.isin(names["token"][order], lone["token"])]
        at = np.full(len(names), -1)
        at[order] = np.arange(len(order))
        bags, first = np.empty(len(order), bag), 0
        for i in range(len(found)):
            to = at[first : first + len(found[i])]
            bags[to[to >= 0]] = found[i][to >= 0]
            first, found[i] = first + len(to), None
        del found, e
        # Of each stretch of words its first row, and the text of a list that it is of.
        new = np.concatenate([[True], np.any([bags[c][1:] != bags[c][:-1] for c in ("token", "key", "lo")], axis=0)]) if len(bags) else np.zeros(0, bool)
        owner = np.cumsum(new) - 1
        text = np.cumsum(np.concatenate([[False], (bags["token"][1:] != bags["token"][:-1]) | (bags["key"][1:] != bags["key"][:-1])]))[new] if len(bags) else owner
        stray = np.isin(node(lists.e["token"][lists.start], lists.e["key"][lists.start]), node(lone["token"], lone["key"]))
        for i, n in zip(lists.first.tolist(), lists.texts.tolist(), strict=True):
            u, v = np.searchsorted(text, [i, i + n])
            a, b = np.searchsorted(owner, [u, v])
            whose = text[u:v] - i
            for x, y in alike(bags["words"][a:b], owner[a:b] - u, stray[i : i + n][whose], int(np.ceil(cfg.identity * cfg.least_words))):
                apart = whose[x] != whose[y]
                x, y = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
                x, y = np.divmod(np.unique(x * (v - u) + y), max(1, v - u))
                fine = passable(bags["words"][a:b], bags["cut"][a:b], owner[a:b] - u, x, y, cfg)
                x, y = whose[x[fine]], whose[y[fine]]
                x, y = np.divmod(np.unique(x * n + y), n)
                # A text may have thousands of places in a list, so pairs are taken by these.
                cuts = np.flatnonzero(np.diff(np.cumsum(lists.places[i + x]) // AT_ONCE)) + 1
                for some in np.split(np.arange(len(x)), cuts) if len(x) else ():
                    sink.add(MATCHES, lists.matches(i + x[some], i + y[some], gaps=True), spread)
                    if sum(len(row[2]) for row in sink.rows) > cfg.shard_bytes // 4:
                        yield pa.RecordBatch.from_arrays(sink.columns(), ["kind", "shard", "data"])
        del lists, bags
        give_back()
        yield pa.RecordBatch.from_arrays(sink.columns(), ["kind", "shard", "data"])

    return written(lone.filter(F.col("kind") == STRAYS).unionByName(texts.mapInArrow(lambda batches: given_back(contexts(batches)), PACKED)).groupBy("shard").applyInArrow(compare, PACKED), "chain-met")


def dealt(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, kind, data) of batches (kind, data) of packed matches, by their two texts; many cells at
    a time, so that what goes to a shard is not in as many pieces."""
    for batch in batches:
        size = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // DEALT)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            some = batch.slice(i, j - i)
            for kind in some.column(0).unique().to_pylist():
                m = np.frombuffer(b"".join(some.column(1).filter(pc.equal(some.column(0), kind)).to_pylist()), MATCH)
                at = (mix64(mix64(np.ascontiguousarray(m["a"]).view(np.uint64)) ^ np.ascontiguousarray(m["b"]).view(np.uint64)) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(at, kind="stable")
                m, at = m[order], at[order]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                parts = [m[a:b].tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(m)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array([kind] * len(first), pa.int32()), pa.array(parts, pa.binary())], ["shard", "kind", "data"])


def _dealt(packed: DataFrame, shards: int) -> DataFrame:
    """(shard, kind, data): packed matches by the shard of their two texts: a seed's length, or with
    kind RUNS least_words, of words of text a from word x is that of text b from word y."""
    return packed.filter(F.col("kind").isin(MATCHES, RUNS)).select("kind", "data").mapInArrow(lambda batches: given_back(dealt(batches, shards)), "shard int, kind int, data binary")


def _chains(matches: DataFrame, cfg: ChainingConfig) -> DataFrame:
    """(a, b, x0, x1, y0, y1, anchors): the chains of each two texts that are long enough to align."""

    def chain(rows: pa.Table) -> pa.Table:
        m = np.concatenate([unpacked(rows, MATCHES, MATCH), run_ends(unpacked(rows, RUNS, MATCH), cfg.least_words - cfg.k)])
        m = m[np.lexsort((m["y"], m["x"], m["b"], m["a"]))]
        m = m[np.concatenate([[True], m[1:] != m[:-1]])]
        a, b, x, y = (np.ascontiguousarray(m[c]) for c in ("a", "b", "x", "y"))
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        size = np.diff(np.append(first, len(a)))
        out = []
        for i, n in zip(first[size >= cfg.least_seeds].tolist(), size[size >= cfg.least_seeds].tolist(), strict=True):
            xs, ys = x[i : i + n], y[i : i + n]
            if xs[-1] - xs[0] + cfg.k < cfg.least_span:
                continue
            kept, spare = [], []
            u, v = xs.tolist(), ys.tolist()
            for found in chains_of(u, v, cfg):
                long = len(found) >= cfg.least_seeds and min(u[found[-1]] - u[found[0]], v[found[-1]] - v[found[0]]) + cfg.k >= cfg.least_span
                kept.append(found) if long else spare.extend(found)
            if len(spare) >= cfg.least_seeds:
                rest = np.array(spare)
                kept += [rest[found] for found in diagonal_chains(xs[rest], ys[rest], cfg)]
            for found in kept:
                cx, cy = xs[found], ys[found]
                anchors = np.empty(len(found), ANCHOR)
                anchors["x"], anchors["y"] = cx, cy
                out.append((int(a[i]), int(b[i]), int(cx[0]), int(cx[-1]) + cfg.k, int(cy[0]), int(cy[-1]) + cfg.k, anchors.tobytes()))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["a", "b", "x0", "x1", "y0", "y1", "anchors"])

    return matches.groupBy("shard").applyInArrow(freeing(chain), "a long, b long, x0 int, x1 int, y0 int, y1 int, anchors binary")


def _slices(docs: DataFrame, spans: DataFrame, cfg: ChainingConfig) -> DataFrame:
    """(chain, side, lo, words): hashes of the words of each span and its margins. Only texts that
    may hold a span, by a membership filter of fixed size, are dealt out."""
    bits = membership(spans.select("key").distinct(), "key")
    shared = session_broadcast(docs.sparkSession, bits, bits.nbytes, 1 << 23)
    margin = cfg.margin

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(shared.value, batch.column(0).to_numpy())))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(batch.columns[1:], ["key", "id", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            at, out, lows = {}, [], []
            texts, los, his = (batch.column(c).to_pylist() for c in (2, 3, 4))
            which = [at.setdefault(text, len(at)) for text in texts]
            hashes, bounds = text_hashes([*at])
            hashes = hashes.astype(np.uint32)
            for i, lo, hi in zip(which, los, his, strict=True):
                lows.append(max(0, lo - margin))
                out.append(hashes[bounds[i] + lows[-1] : min(bounds[i + 1], bounds[i] + hi + margin)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lows, pa.int32()), pa.array(out, pa.binary())], ["chain", "side", "lo", "words"])

    texts = docs.select(slot_of(F.col("key")).alias("slot"), "key", F.col("doc_id").alias("id"), "text").mapInArrow(lambda batches: given_back(only(batches)), "key long, id long, text binary")
    rows = spans.join(texts, ["key", "id"]).select("chain", "side", "text", "lo", "hi")
    return rows.mapInArrow(lambda batches: given_back(cut(batches)), "chain long, side int, lo int, words binary").dropDuplicates(["chain", "side"])


def _passages(left: DataFrame, right: DataFrame, chains: DataFrame, cfg: ChainingConfig) -> DataFrame:
    """Aligns each chain on the words of both texts and keeps what is long and alike enough."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for *ids, anchors, lo_a, words_a, lo_b, words_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.frombuffer(anchors, ANCHOR)
                for x0, x1, y0, y1, agree in passages(np.frombuffer(words_a, np.uint32), np.frombuffer(words_b, np.uint32), at["x"] - lo_a, at["y"] - lo_b, cfg):
                    out.append((*ids, x0 + lo_a, x1 + lo_a, y0 + lo_b, y1 + lo_b, agree / max(x1 - x0, y1 - y0)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 8, pa.float64()), strict=True)], ["a", "b", "doc_id", "other_doc_id", "start", "stop", "other_start", "other_stop", "identity"])

    rows = chains.join(left.select("chain", F.col("lo").alias("lo_a"), F.col("words").alias("words_a")), "chain").join(right.select("chain", F.col("lo").alias("lo_b"), F.col("words").alias("words_b")), "chain")
    return rows.select("a", "b", "id_a", "id_b", "anchors", "lo_a", "words_a", "lo_b", "words_b").mapInArrow(lambda batches: given_back(align(batches)), "a long, b long, doc_id long, other_doc_id long, start long, stop long, other_start long, other_stop long, identity double")


def _found(rows: DataFrame, ids: DataFrame, packed: DataFrame, cfg: ChainingConfig, shards: int) -> DataFrame:
    """The passages of packed matches, with the keys a and b of their texts; the tables they are read
    from as `scratch`."""
    chains = _chains(_dealt(packed, shards), cfg)
    chains = chains.join(ids.select(F.col("key").alias("a"), F.col("id").alias("id_a")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("id_b")), "b")
    chains = written(chains.withColumn("chain", F.monotonically_increasing_id()), "chain-chains")
    sides = [chains.select("chain", F.lit(i).alias("side"), F.col(k).alias("key"), F.col(f"id_{k}").alias("id"), F.col(f"{p}0").alias("lo"), F.col(f"{p}1").alias("hi")) for i, (k, p) in enumerate((("a", "x"), ("b", "y")))]
    slices = written(_slices(rows, sides[0].unionByName(sides[1]), cfg), "chain-slices")
    out = _passages(slices.filter("side = 0"), slices.filter("side = 1"), chains, cfg)
    out.scratch = chains, slices
    return out


def repeated_passages(docs: DataFrame, cfg: ChainingConfig | None = None) -> DataFrame:
    """(doc_id, other_doc_id, start, stop, other_start, other_stop, identity): word spans of two
    texts, or of one text, that repeat each other; and, for every copy, its class's first document."""
    cfg = cfg or ChainingConfig()
    spark = docs.sparkSession
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    narrow = written(docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("key"), word_count(F.col("text")).alias("n")), "chain-docs")
    classes = written(narrow.groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("size"), F.sum("n").alias("words")), "chain-classes")
    words = classes.agg(F.sum(F.col("words") / F.col("size"))).first()[0] or 0
    size = words * SEED.itemsize * 2 / (cfg.window + 1)
    least, sized = int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // cfg.shard_bytes) + 1
    # What is told of a list's places takes far more than its seeds, so tasks take fewer lists at once.
    shards, finer = max(least, sized), max(least, FINER * sized)
    ids = classes.select("key", "id")
    packed = written(_lists(_seeds(rows, cfg, shards), cfg, shards), "chain-lists")
    common = written(_numbers(packed, COMMON).distinct(), "chain-common")
    if not common.take(1):
        found = _found(rows, ids, packed, cfg, shards)
    else:
        tokens, keys = _filter(spark, common), _filter(spark, _numbers(packed, HOLDERS).distinct())
        again = written(_common(rows, tokens, keys, cfg, shards), "chain-again")
        found = _found(rows, ids, packed.unionByName(again), cfg, shards)
        lists = again.filter(F.col("kind") == LONG)
        if lists.take(1):
            scratch = found.scratch
            found = written(found, "chain-found")
            forget(packed, *scratch)
            met = _strays(rows, tokens, keys, _numbers(lists, LONG), found, cfg, finer)
            forget(again)
            if met is not None and met.take(1):
                found = found.unionByName(_found(rows, ids, met, cfg, finer)).distinct()
                forget(met)
    found = found.drop("a", "b")
    copies = narrow.join(classes.filter("size > 1").select("key", "id"), "key").filter((F.col("doc_id") != F.col("id")) & (F.col("n") >= cfg.least_words))
    copies = copies.select("doc_id", F.col("id").alias("other_doc_id"), F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"), F.lit(0).cast("long").alias("other_start"), F.col("n").alias("other_stop"), F.lit(1.0).alias("identity"))
    return found.unionByName(copies)
