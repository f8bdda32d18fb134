import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemark import functions as W


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {t}" for k, t in zip(cells, ["float"] * len(cells), strict=True))).select(column.alias("v")).first()["v"] if cells else spark.range(1).select(column.alias("v")).first()["v"]


def test_hann_is_periodic(spark):
    w = value(spark, W.hann_window(256))
    assert len(w) == 256 and w[0] < 1e-6 and w[255] < 0.01 and abs(w[128] - 1) < 1e-6
    assert len(W.hann_weights(1024)) == 1024


@pytest.mark.parametrize(("freq", "bin_"), [(440.0, 41), (11025.0, 1023), (-5.0, 0), (float("nan"), 0), (float("inf"), 1023), (0.5 * 22050 / 2048, 1)])
def test_freq_to_bin(spark, freq, bin_):
    assert value(spark, W.freq_to_bin(F.col("x"), 22050 / 2048, 1024), x=freq) == bin_


@pytest.mark.parametrize(("dt", "q"), [(0.0, 0), (0.005, 1), (0.5, 50), (-1.0, 0), (1e30, (1 << 32) - 1)])
def test_quantize_dt(spark, dt, q):
    assert value(spark, W.quantize_dt(F.col("x"), 0.01), x=dt) == q


def test_pack_and_unpack(spark):
    h = value(spark, W.pack_hash(F.lit(1), F.lit(2), F.lit(3)))
    assert h == (1 << 40) | (2 << 20) | 3
    assert [value(spark, c) for c in W.unpack_hash(F.lit(h))] == [1, 2, 3]
    assert value(spark, W.pack_hash(F.lit(1 << 20), F.lit(0), F.lit(0))) == 0
    assert value(spark, W.pack_hash(F.lit(100), F.lit(200), F.lit(50))) != value(spark, W.pack_hash(F.lit(100), F.lit(201), F.lit(50)))


@pytest.mark.parametrize(("offset", "bin_"), [(0.025, 1), (-0.025, -1), (1.0, 20), (0.02, 0)])
def test_offset_bins_round_away_from_zero(spark, offset, bin_):
    got = value(spark, W.offset_to_bin(F.col("x"), 0.05), x=offset)
    assert got == bin_ and abs(value(spark, W.bin_to_offset(F.lit(got), 0.05)) - got * 0.05) < 1e-6


def test_downmix_and_duration(spark):
    row = spark.createDataFrame([([0.5, -0.5, 1.0, 0.0, -1.0, 1.0, 9.0], 22050)], "s array<float>, r int")
    assert row.select(W.downmixed(F.col("s"), 2)).first()[0] == [0.0, 0.5, 0.0]
    assert row.select(W.downmixed(F.col("s"), 1)).first()[0] == [0.5, -0.5, 1.0, 0.0, -1.0, 1.0, 9.0]
    zeros = spark.createDataFrame([([0.0] * 100, 50), ([0.0] * 100, 0)], "s array<float>, r int")
    assert [r[0] for r in zeros.select(W.duration_secs(F.col("s"), F.col("r"))).collect()] == [2.0, 0.0]


def test_large_hashes_keep_equality():
    assert W.python_hash(1 << 63) == -(1 << 63) and W.python_hash(5) == 5 and W.python_hash((1 << 64) - 1) == -1


def test_sql_functions_agree(spark):
    W.register_sql(spark)
    got = spark.sql("select wave_hann(1, 4) a, wave_freq_to_bin(cast(440 as float), cast(10.766602 as float), 1024) b, wave_quantize_dt(cast(0.5 as float), cast(0.01 as float)) c, wave_pack_hash(1, 2, 3) d, wave_offset_to_bin(cast(1 as float), cast(0.05 as float)) e, wave_bin_to_offset(20, cast(0.05 as float)) f").first()
    assert abs(got.a - 0.5) < 1e-6 and (got.b, got.c, got.d, got.e) == (41, 50, (1 << 40) | (2 << 20) | 3, 20) and math.isclose(got.f, 1.0, rel_tol=1e-6)


def test_single_precision_steps(spark):
    x = np.random.default_rng(0).random(200).astype(np.float32) * 200
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x float")
    got = [r[0] for r in rows.orderBy("i").select(W.divided(F.col("x"), 0.05)).collect()]
    assert np.array_equal(np.array(got, np.float32), x / np.float32(0.05))
