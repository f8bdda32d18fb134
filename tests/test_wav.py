import struct
import wave

import numpy as np
import pytest

from wavemark.api import Fingerprinter
from wavemark.cli import main
from wavemark.errors import AudioTooShort, FileNotFound, InvalidWavFormat, UnsupportedAudioFormat
from wavemark.sources import datasource
from wavemark.sources.riff import decode, downmix
from wavemark.sources.wav import FileSource, failed, good, load_wav, read_wavs, validate_audio_file
from wavemark.streaming import file_stream, identify_stream


def write(path, samples, rate=22050, width=2, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        top = (1 << (8 * width - 1)) - 1
        ints = np.round(np.asarray(samples) * top).astype(np.int64)
        raw = (ints + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(width, "little", signed=True) for v in ints)
        f.writeframes(raw)
    return str(path)


def song(seed, seconds=6.0):
    """Bursts of tones: enough peaks to recognise."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(22050 * seconds)) / 22050
    x = np.zeros(len(t))
    for start in np.arange(0, seconds - 0.2, 0.12):
        on = (t >= start) & (t < start + 0.15)
        x[on] += 0.3 * np.sin(2 * np.pi * rng.uniform(200, 5000) * t[on]) * np.hanning(on.sum())
    return np.clip(x + rng.normal(size=len(t)) * 1e-4, -1, 1)


@pytest.mark.parametrize(("width", "tolerance"), [(1, 0.02), (2, 1e-4), (3, 1e-6), (4, 1e-6)])
def test_integer_widths(tmp_path, width, tolerance):
    x = [0.0, 0.5, -0.5, 0.99, -0.99]
    out = load_wav(write(tmp_path / "a.wav", x, width=width))
    assert np.allclose(out.samples, x, atol=tolerance) and out.sample_rate == 22050 and out.original_channels == 1
    assert out.num_samples() == 5


def test_stereo_and_float(tmp_path):
    assert np.allclose(load_wav(write(tmp_path / "s.wav", [0.5, -0.5, 0.99, 0.0, -0.99, 0.99], channels=2)).samples, [0, 0.495, 0], atol=1e-3)
    assert downmix(np.array([0.1, 0.2, 0.3, 0.4], np.float32), 1).tolist() == pytest.approx([0.1, 0.2, 0.3, 0.4])
    data = np.array([0.25, -2.0, np.nan], "<f4").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 3, 1, 8000, 32000, 4, 32, b"data", len(data))
    out = decode(head + data, "f.wav")
    assert out.samples[:2].tolist() == [0.25, -2.0] and np.isnan(out.samples[2]) and out.duration_secs() == pytest.approx(3 / 8000)


def test_bad_files(tmp_path):
    with pytest.raises(FileNotFound, match="/nonexistent/path/file.wav"):
        load_wav("/nonexistent/path/file.wav")
    for content in (b"", b"not a wave file at all", b"RIFF\0\0\0\0WAVE"):
        with pytest.raises(InvalidWavFormat):
            decode(content, "x")
    alaw = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 37, b"WAVE", b"fmt ", 16, 6, 1, 8000, 8000, 1, 8, b"data", 1) + b"\0"
    with pytest.raises(InvalidWavFormat):
        decode(alaw, "x")
    good_file = open(write(tmp_path / "g.wav", [0.1] * 50), "rb").read()
    with pytest.raises(InvalidWavFormat):
        decode(good_file[:-20], "x")
    with pytest.raises(AudioTooShort):
        load_wav(write(tmp_path / "e.wav", []))


def test_validation(tmp_path):
    path = write(tmp_path / "A.WAV", [0.1])
    assert validate_audio_file(path).endswith("A.WAV") and len(FileSource(path).read()) == 1
    (tmp_path / "x.mp3").write_bytes(b"")
    (tmp_path / "bare").write_bytes(b"")
    for name in ("x.mp3", "bare"):
        with pytest.raises(UnsupportedAudioFormat):
            validate_audio_file(str(tmp_path / name))
    with pytest.raises(FileNotFound):
        validate_audio_file(str(tmp_path / "none.wav"))


def test_folder_scan_is_permissive(spark, tmp_path):
    write(tmp_path / "one.wav", [0.1, 0.2])
    write(tmp_path / "two.WAV", [0.3], rate=8000)
    (tmp_path / "bad.wav").write_bytes(b"junk")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "deep.wav", [0.1])
    rows = read_wavs(spark, str(tmp_path))
    assert {(r.track_name, len(r.samples), r.sample_rate) for r in good(rows).collect()} == {("one", 2, 22050), ("two", 1, 8000)}
    (bad,) = failed(rows).collect()
    assert bad.track_name == "bad" and "not a WAV file" in bad.error
    with pytest.raises(Exception, match="not a WAV file"):
        read_wavs(spark, str(tmp_path), strict=True).collect()


def test_data_source(spark, tmp_path):
    write(tmp_path / "one.wav", [0.1, 0.2])
    datasource.register(spark)
    (row,) = spark.read.format("wave").load(str(tmp_path)).collect()
    assert row.track_name == "one" and len(row.samples) == 2


def test_fingerprinter_errors(spark, tmp_path):
    f = Fingerprinter(spark)
    with pytest.raises(OSError):
        f.fingerprint_file("nonexistent.wav")
    with pytest.raises(RuntimeError):
        f.fingerprint_file(write(tmp_path / "short.wav", [0.1] * 100))


def test_cli_and_stream(spark, tmp_path, capsys):
    db, music = f"file://{tmp_path}/db", tmp_path / "music"
    for command in (["info", "--db", db], ["query", "--db", db, "x.wav"]):
        with pytest.raises(SystemExit, match="does not exist"):
            main(command, spark)
    music.mkdir()
    (music / "broken.wav").write_bytes(b"?")
    songs = {name: song(i) for i, name in enumerate(("alpha", "beta"))}
    for name, x in songs.items():
        write(music / f"{name}.wav", x)
    assert main(["-v", "index", "--db", db, str(music)], spark) == 0
    out = capsys.readouterr().out
    assert "3 files to index" in out and "skipped broken" in out and "beta: " in out and "2 of 3 files" in out
    assert main(["info", "--db", db], spark) == 0
    assert "Tracks indexed: 2" in capsys.readouterr().out
    hop = 512
    clip = songs["beta"][100 * hop : 100 * hop + 44100]
    path = write(tmp_path / "clip.wav", clip)
    assert main(["query", "--db", db, path, "-v"], spark) == 0
    out = capsys.readouterr().out
    assert "Match found: beta" in out and abs(float(out.split("Offset: ")[1].split("s")[0]) - 100 * hop / 22050) < 0.1
    assert main(["query", "--db", db, write(tmp_path / "hush.wav", np.zeros(30000))], spark) == 0
    assert "No match found." in capsys.readouterr().out
    assert main(["query", "--db", db, str(tmp_path / "none.wav")], spark) == 1

    from wavemark.sources import store

    arrivals, seen = tmp_path / "in", []
    arrivals.mkdir()
    write(arrivals / "heard.wav", clip)
    query = identify_stream(file_stream(spark, str(arrivals)), store.load(spark, db), lambda rows, n: seen.extend(rows.collect()), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert [(r.query_id, r.track_id, r.status) for r in seen] == [("heard", "beta", "match")]


def test_empty_folder_creates_a_database(spark, tmp_path, capsys):
    (tmp_path / "none").mkdir()
    assert main(["index", "--db", f"file://{tmp_path}/db", str(tmp_path / "none")], spark) == 0
    assert main(["info", "--db", f"file://{tmp_path}/db"], spark) == 0
    assert "Total hashes: 0" in capsys.readouterr().out


def test_files_of_any_name(spark, tmp_path, capsys):
    db, x = f"file://{tmp_path}/db", song(3)
    bare = write(tmp_path / "tune.bin", x)
    folder = tmp_path / "odd.wav"
    folder.mkdir()
    write(folder / "in.wAv", x[:40000])
    (folder / "notes.txt").write_text("x")
    assert [r.track_name for r in read_wavs(spark, bare).collect()] == ["tune"]
    assert [(r.track_name, r.error) for r in read_wavs(spark, str(folder)).collect()] == [("in", None)]
    assert main(["index", "--db", db, bare], spark) == 0 and "1 of 1 files" in capsys.readouterr().out
    assert main(["query", "--db", db, bare], spark) == 0 and "Match found: tune" in capsys.readouterr().out
    (tmp_path / "bad").write_bytes(b"junk")
    assert main(["query", "--db", db, str(tmp_path / "bad")], spark) == 1
    assert main(["index", "--db", db, str(tmp_path / "none")], spark) == 1


def test_a_save_that_dies_leaves_an_index(spark, tmp_path, monkeypatch):
    from wavemark.operators.index import FingerprintIndex
    from wavemark.sources import store

    path = f"file://{tmp_path}/db"
    make = lambda n: FingerprintIndex.build(spark.createDataFrame([(f"t{n}", i, n, 0.0) for i in range(n)], "track_name string, seq int, hash bigint, anchor_time float"))
    store.save(make(2), path)
    reader = store.load(spark, path)
    with monkeypatch.context() as m:
        m.setattr(store.Store, "clear", lambda self: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.save(make(3), path)
    assert store.load(spark, path).hash_count() == 3 and reader.hash_count() == 2
    with monkeypatch.context() as m:
        m.setattr(store.Store, "point", lambda self, meta: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.save(make(4), path)
    assert store.load(spark, path).hash_count() == 3
    store.save(make(5), path)
    assert store.load(spark, path).hash_count() == 5 and store.Store(spark, path).numbers() == [2, 3]
    assert sum(x.startswith("snapshot-") for x in store.Store(spark, path).children()) == 2
