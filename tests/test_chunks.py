import os

import numpy as np
import pytest
from test_wav import song, write

from wavemark.config import PipelineConfig
from wavemark.errors import InvalidWavFormat
from wavemark.operators.chunks import fingerprints_from_chunks, peaks_from_chunks, spans, split_signals
from wavemark.operators.hashes import fingerprints_from_signals
from wavemark.operators.peaks import peaks_from_signals
from wavemark.sources import datasource
from wavemark.sources.riff import located, samples_between
from wavemark.sources.wav import good, load_wav, read_wavs

CFG = PipelineConfig.derive(22050, 256, 64, {"time_neighborhood": 5, "freq_neighborhood": 4, "threshold_db": -60.0}, {"max_dt": 0.2, "fan_value": 6})
ROWS = lambda df: sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def music(tmp_path_factory):
    at = tmp_path_factory.mktemp("long")
    for i, n in enumerate((60_000, 20_000, 256, 255)):
        write(at / f"t{i}.wav", song(i)[:n])
    return at


@pytest.mark.parametrize("frames", [1, 37, 300, 100_000])
def test_spans_cover_a_track(frames):
    found = list(spans(1000, CFG, frames))
    assert [x for first, last, _, _ in found for x in range(first, last)] == list(range(1000))
    assert all(start <= first and last <= end <= 1000 for first, last, start, end in found)


def test_chunks_of_files_give_the_peaks_of_whole_files(spark, music):
    datasource.register(spark)
    frames = 100
    chunks = spark.read.format("wave_chunks").options(**datasource.chunk_options(CFG, frames)).load(str(music))
    whole = good(read_wavs(spark, str(music)))
    expected = ROWS(peaks_from_signals(whole, CFG))
    assert ROWS(peaks_from_chunks(chunks, CFG)) == expected and len(expected) > 100
    prints = ROWS(fingerprints_from_signals(whole, CFG).select("track_name", "seq", "hash", "anchor_time"))
    assert ROWS(fingerprints_from_chunks(chunks, CFG)) == prints and len(prints) > 500
    sizes = [len(r.samples) for r in chunks.select("samples").collect()]
    before, after = 5, 5 + int(0.2 / CFG.peaks.time_per_frame) + 2
    assert max(sizes) <= (frames + before + after - 1) * 64 + 256
    assert chunks.rdd.getNumPartitions() == len(sizes) == 10 + 4 + 1


def test_chunks_of_signals(spark, music):
    whole = good(read_wavs(spark, str(music)))
    for cfg in (CFG, PipelineConfig.derive(22050, 256, 64, {"time_neighborhood": 0, "freq_neighborhood": 2, "threshold_db": -60.0}, {"max_dt": 0.1, "min_dt": 0.02})):
        chunks = split_signals(whole, cfg, 64)
        assert ROWS(peaks_from_chunks(chunks, cfg)) == ROWS(peaks_from_signals(whole, cfg))
        assert ROWS(fingerprints_from_chunks(chunks, cfg)) == ROWS(fingerprints_from_signals(whole, cfg).select("track_name", "seq", "hash", "anchor_time"))


@pytest.mark.parametrize(("bits", "channels", "floats"), [(8, 1, False), (16, 2, False), (24, 2, False), (32, 1, False), (32, 2, True)])
def test_parts_of_a_file_are_decoded_alike(tmp_path, bits, channels, floats):
    from wavemark.plans.catalogue import _wav_bytes

    path = str(tmp_path / "x.wav")
    with open(path, "wb") as f:
        f.write(_wav_bytes(np.sin(np.arange(500) / 7).astype(np.float32), bits, channels, floats))
    all_ = load_wav(path).samples
    with open(path, "rb") as f:
        form, at, n = located(f, path)
        assert n == len(all_)
        parts = [samples_between(f, form, at, i, min(n, i + 77), path) for i in range(0, n, 77)]
    assert np.array_equal(np.concatenate(parts), all_)


def test_bad_files(spark, tmp_path):
    datasource.register(spark)
    write(tmp_path / "one.wav", song(1)[:3000])
    (tmp_path / "bad.wav").write_bytes(b"junk")
    (tmp_path / "cut.wav").write_bytes(open(tmp_path / "one.wav", "rb").read()[:-9])
    rows = spark.read.format("wave_chunks").options(**datasource.chunk_options(CFG)).load(str(tmp_path))
    found = {r.track_name: r.error for r in rows.collect()}
    assert found["one"] is None and "RIFF" in found["bad"] and "cut short" in found["cut"]
    assert {r.track_name for r in peaks_from_chunks(rows, CFG).select("track_name").distinct().collect()} == {"one"}
    with pytest.raises(Exception, match="RIFF|cut short"):
        spark.read.format("wave_chunks").option("mode", "strict").load(str(tmp_path)).collect()
    with open(tmp_path / "bad.wav", "rb") as f, pytest.raises(InvalidWavFormat):
        located(f, "bad")


def test_stream_takes_each_file_once(spark, tmp_path):
    datasource.register(spark)
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def arrive(name, time=None):
        write(tmp_path / "new.wav", [0.1, 0.2, 0.3])
        if time:
            os.utime(tmp_path / "new.wav", (time, time))
        os.rename(tmp_path / "new.wav", folder / name)

    def run():
        stream = spark.readStream.format("wave").option("settle", 0).load(str(folder))
        query = stream.select("track_name").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        arrive(f"during{len(os.listdir(folder))}.wav")
        query.processAllAvailable()
        query.stop()
        return sorted(r.track_name for r in spark.read.schema("track_name string").parquet(out).collect())

    for i in range(3):
        arrive(f"a{i}.wav")
    (folder / "bad.wav").write_bytes(b"junk")
    first = ["a0", "a1", "a2", "during4"]
    assert run() == first
    arrive("old.wav", 1000)  # its own time is long past
    os.remove(folder / "during4.wav")
    assert run() == sorted([*first, "during5", "old"])
    os.remove(folder / "during5.wav")
    assert run() == sorted([*first, "during5", "old", "during5"])
