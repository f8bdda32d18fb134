import pytest
from test_wav import song, write

from wavemark.config import PipelineConfig
from wavemark.operators.chunks import fingerprints_from_chunks, split_signals
from wavemark.operators.index import FingerprintIndex
from wavemark.plans import as_queries, fingerprint
from wavemark.schemas import CHUNKS
from wavemark.sources.wav import good, read_wavs
from wavemark.streaming.live import live_identify

CFG = PipelineConfig.derive(22050, 256, 64, {"time_neighborhood": 5, "freq_neighborhood": 4, "threshold_db": -60.0}, {"max_dt": 0.2, "fan_value": 6})


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # Batches without data would go on for ever, as timers may fire in them.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset(name)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_state_after_the_last_chunk_is_the_batch_answer(spark, tmp_path, rocks):
    music, folder = tmp_path / "music", tmp_path / "chunks"
    music.mkdir()
    for i in range(3):
        write(music / f"t{i}.wav", song(i)[:20_000])
    held = fingerprint(good(read_wavs(spark, str(music))), CFG)
    index = FingerprintIndex.build(held.cache())
    index = FingerprintIndex(index.tracks.cache(), index.postings.cache())
    clips = tmp_path / "clips"
    clips.mkdir()
    for i in range(2):
        write(clips / f"c{i}.wav", song(i)[6_400:17_000])
    chunks = split_signals(good(read_wavs(spark, str(clips))), CFG, 60).cache()
    firsts = sorted({r["first"] for r in chunks.select("first").collect()})
    for first in firsts:
        chunks.filter(f"first = {first}").coalesce(1).write.mode("append").parquet(str(folder))
    seen = []

    def run(timeout_ms):
        stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(folder))
        rows = live_identify(stream, index, CFG, timeout_ms)
        query = rows.writeStream.foreachBatch(lambda df, n: seen.extend((n, r) for r in df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)

    run(3_600_000)
    expected = {r.query_id: (r.track_id, r["score"], r.offset_bin) for r in index.query_batch(as_queries(fingerprints_from_chunks(chunks, CFG))).collect()}
    last = {r.query_id: (r.track_id, r["score"], r.offset_bin) for _, r in seen}
    assert last == expected and {k: v[0] for k, v in last.items()} == {"c0": "t0", "c1": "t1"}
    scores = [r["score"] for _, r in seen if r.query_id == "c0"]
    assert len({n for n, _ in seen}) == len(firsts) > 2 and scores == sorted(scores) and scores[0] < scores[-1]
    assert not any(r.ended for _, r in seen)


def test_a_query_that_stops_ends_once():
    import pandas as pd

    from wavemark.streaming.live import Votes

    class Value:
        def __init__(self):
            self.held = None

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

        def clear(self):
            self.held = None

    class Table(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    class Handle:
        def __init__(self):
            self.timers = []

        def getMapState(self, *_):
            return Table()

        def getValueState(self, *_):
            return Value()

        def listTimers(self):
            return iter(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    class Timers:
        now = 1000

        def getCurrentProcessingTimeInMs(self):
            return self.now

    votes, handle, timers = Votes(500), Handle(), Timers()
    votes.init(handle)
    batch = lambda *rows: iter([pd.DataFrame(rows, columns=["track_name", "offset_bin", "asked"])])
    (row,) = votes.handleInputRows(("q",), batch(("b", 2000, 1), ("a", -3, 1)), timers)
    assert row.iloc[0].tolist() == ["q", "a", 1, -3, 2, False] and handle.timers == [1500]
    timers.now = 1200
    (row,) = votes.handleInputRows(("q",), batch(("b", 2000, 1), ("b", 2000, 1), ("a", 7, 1)), timers)
    assert row.iloc[0].tolist() == ["q", "b", 3, 2000, 5, False] and handle.timers == [1700]
    (row,) = votes.handleExpiredTimer(("q",), timers, None)
    assert row.iloc[0].tolist() == ["q", "b", 3, 2000, 5, True]
    assert votes.best.get() is None and not votes.votes
