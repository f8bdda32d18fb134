"""Identification while audio runs: each query keeps its votes as state, from chunk to chunk."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import functions as W
from ..config import PipelineConfig
from ..operators.chunks import local_prints
from ..operators.index import FingerprintIndex

#: Offsets whose votes are one value of the state: each is read and written once a batch.
BINS = 1_024
RESULTS = "query_id string, track_id string, score bigint, offset_bin bigint, votes bigint, ended boolean"


class Votes(StatefulProcessor):
    """Votes by track and offset, and the best of them. Scores only grow, so after each batch the best
    is the old one or among those that changed: score falling, then name, then offset. A query that
    brings nothing for `timeout_ms` ends: its best is given a last time and its state goes."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.votes = handle.getMapState("votes", "track_id string, block bigint", "bins array<int>, scores array<bigint>")
        self.best = handle.getValueState("best", "score bigint, track_id string, offset_bin bigint, votes bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new: defaultdict[tuple, Counter] = defaultdict(Counter)
        for frame in rows:
            counts = frame.groupby(["track_name", "offset_bin"], sort=False)["asked"].sum()
            for (track, bin_), n in counts.items():
                new[str(track), int(bin_) // BINS][int(bin_) % BINS] += int(n)
        held = self.best.get()
        total = sum(sum(x.values()) for x in new.values()) + (held[3] if held else 0)
        tops = [(-held[0], held[1], held[2])] if held else []
        for (track, block), counts in new.items():
            before = self.votes.getValue((track, block))
            scores = Counter(dict(zip(*before, strict=True)) if before else {})
            scores.update(counts)
            self.votes.updateValue((track, block), (list(scores), list(scores.values())))
            tops += [(-scores[x], track, block * BINS + x) for x in counts]
        score, track, bin_ = min(tops)
        self.best.update((-score, track, bin_, total))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield self._row(key, False)

    def handleExpiredTimer(self, key: tuple, timers, expired) -> Iterator[pd.DataFrame]:
        row = self._row(key, True)
        self.votes.clear()
        self.best.clear()
        yield row

    def _row(self, key: tuple, ended: bool) -> pd.DataFrame:
        score, track, bin_, total = self.best.get()
        return pd.DataFrame({"query_id": [key[0]], "track_id": [track], "score": [score], "offset_bin": [bin_], "votes": [total], "ended": [ended]})


def live_votes(queries: DataFrame, index: FingerprintIndex, timeout_ms: int = 600_000) -> DataFrame:
    """RESULTS whenever a query's best may have changed, from a stream of (query_id, hash, anchor_time)
    against a fixed index. Needs the state store of RocksDB. Tracks and offsets are those of the batch
    answer (`query_batch`) to all that has come."""
    bins = W.offset_to_bin(F.col("anchor_time") - F.col("query_time"), index.config.offset_bin_size)
    asked = queries.select("query_id", "hash", F.col("anchor_time").alias("query_time"))
    hits = asked.join(index.postings, "hash").join(index.tracks, "track_id").select("query_id", "track_name", bins.alias("offset_bin"), F.lit(1).alias("asked"))
    return hits.groupBy("query_id").transformWithStateInPandas(Votes(timeout_ms), RESULTS, "Update", "ProcessingTime")


def live_identify(chunks: DataFrame, index: FingerprintIndex, cfg: PipelineConfig | None = None, timeout_ms: int = 600_000) -> DataFrame:
    """The same from a stream of chunks of audio, a query for each track_name."""
    prints = local_prints(chunks, cfg or PipelineConfig()).filter("hash is not null")
    return live_votes(prints.select(F.col("track_name").alias("query_id"), "hash", "anchor_time"), index, timeout_ms)
