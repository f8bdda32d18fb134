import numpy as np
import pytest

from wavemark.config import SpectrogramConfig
from wavemark.errors import SpectrogramError
from wavemark.functions.tables import PiecewiseSpectrogram, register_tables
from wavemark.operators.spectrogram import spectrogram

RNG = np.random.default_rng(1)
TRACKS = {name: RNG.normal(size=n).astype(np.float32) for name, n in (("a", 5000), ("b", 64), ("c", 63), ("d", 701))}


@pytest.mark.parametrize(("window", "hop"), [(64, 16), (64, 64), (64, 100)])
def test_table_function_equals_the_operator(spark, window, hop):
    register_tables(spark)
    cfg = SpectrogramConfig(window, hop)
    whole = spark.createDataFrame([(k, x.tolist()) for k, x in TRACKS.items()], "track_name string, samples array<float>")
    pieces = [(k, i, x[at : at + 37 + i % 90].tolist()) for k, x in TRACKS.items() for i, at in _cuts(len(x))]
    spark.createDataFrame(pieces + [("c", 99, None), ("e", 0, None)], "track_name string, place int, samples array<float>").repartition(3).createOrReplaceTempView("pieces")
    rows = spark.sql(f"SELECT * FROM wave_spectrogram(TABLE(SELECT * FROM pieces) PARTITION BY track_name ORDER BY (place), {window}, {hop})")
    key = lambda df: sorted((r.track_name, r.frame, tuple(r.db)) for r in df.collect())
    got, expected = key(rows), key(spectrogram(whole, cfg))
    assert [x[:2] for x in got] == [x[:2] for x in expected]
    np.testing.assert_allclose([x[2] for x in got], [x[2] for x in expected], rtol=1e-5, atol=1e-4)


def _cuts(n):
    at, i = 0, 0
    while at < n:
        yield i, at
        at += 37 + i % 90
        i += 1


def test_pieces_keep_less_than_a_window():
    track = PiecewiseSpectrogram(64, 16)
    for _ in range(50):
        list(track.add(np.ones(33, np.float32)))
        assert len(track.rest) < 64
    with pytest.raises(SpectrogramError):
        PiecewiseSpectrogram(0, 16)
