"""Column functions of the pipeline, in single precision.

Spark divides floats as doubles; rounding each single operation back to float gives the correctly
rounded float result, so these agree bit for bit with single-precision arithmetic. Rounding is half
away from zero, and conversions saturate instead of failing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FIELD_BITS = 20
FIELD_MASK = (1 << FIELD_BITS) - 1
U32_MAX = (1 << 32) - 1


def f32(value: float) -> float:
    """The nearest single-precision number."""
    return float(np.float32(value))


def divided(a: Column, b: float) -> Column:
    return (a.cast("double") / F.lit(f32(b))).cast("float")


def hann_weights(n: int) -> list[float]:
    """The periodic Hann window (divided by n, not n - 1)."""
    return [f32(0.5 * (1 - math.cos(2 * math.pi * i / n))) for i in range(n)]


def hann_window(n: int) -> Column:
    return F.array(*[F.lit(w).cast("float") for w in hann_weights(n)])


def frame_count(samples: Column, window: int, hop: int) -> Column:
    return F.when(F.size(samples) >= window, F.floor((F.size(samples) - window) / hop) + 1).otherwise(0).cast("int")


def framed(samples: Column, frame: Column, window: int, hop: int) -> Column:
    return F.slice(samples, frame * hop + 1, window)


def windowed(frame: Column, n: int) -> Column:
    return F.zip_with(frame, hann_window(n), lambda x, w: x * w)


def decibels(power: Column) -> Column:
    return (10 * F.log10(power + 1e-10)).cast("float")


def pcm_sample(value: Column, bits: int) -> Column:
    """An integer sample as a float in [-1, 1)."""
    return (value.cast("double") / float(1 << (bits - 1))).cast("float")


def downmixed(samples: Column, channels: int) -> Column:
    """Mean over interleaved channels, summed in their order; a last partial frame is dropped."""
    if channels == 1:
        return samples
    frames = F.floor(F.size(samples) / channels).cast("int")

    def mean(i: Column) -> Column:
        total = F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0).cast("float"), lambda acc, x: acc + x)
        return divided(total, channels)

    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), mean)).otherwise(F.array().cast("array<float>"))


def duration_secs(samples: Column, sample_rate: Column) -> Column:
    return F.when(sample_rate > 0, (F.size(samples).cast("double") / sample_rate).cast("float")).otherwise(F.lit(0.0).cast("float"))


def frame_time(frame: Column, time_per_frame: float) -> Column:
    return frame.cast("float") * F.lit(f32(time_per_frame)).cast("float")


def bin_freq(bin_: Column, freq_per_bin: float) -> Column:
    return bin_.cast("float") * F.lit(f32(freq_per_bin)).cast("float")


def rounded_u32(x: Column) -> Column:
    """Rounded and saturated to 0..2**32-1; not a number gives 0."""
    return F.when(F.isnan(x), F.lit(0)).otherwise(F.least(F.greatest(F.round(x).cast("double"), F.lit(0.0)), F.lit(float(U32_MAX))).cast("long"))


def freq_to_bin(freq: Column, resolution: float, bins: int) -> Column:
    return F.least(rounded_u32(divided(freq, resolution)), F.lit(bins - 1).cast("long"))


def quantize_dt(dt: Column, resolution: float) -> Column:
    return rounded_u32(divided(dt, resolution))


def pack_hash(f1: Column, f2: Column, dt: Column) -> Column:
    """Three fields of 20 bits."""
    f1, f2, dt = (x.cast("long").bitwiseAND(FIELD_MASK) for x in (f1, f2, dt))
    return F.shiftleft(f1, 2 * FIELD_BITS).bitwiseOR(F.shiftleft(f2, FIELD_BITS)).bitwiseOR(dt)


def unpack_hash(h: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(h, k * FIELD_BITS).bitwiseAND(FIELD_MASK) for k in (2, 1, 0))


def offset_to_bin(offset: Column, size: float) -> Column:
    return F.round(divided(offset, size)).cast("long")


def bin_to_offset(bin_: Column, size: float) -> Column:
    return bin_.cast("float") * F.lit(f32(size)).cast("float")


def python_hash(value: int) -> int:
    """An unsigned 64-bit hash as Spark's signed long; equality is kept."""
    return value - (1 << 64) if value >= 1 << 63 else value


def register_sql(spark: SparkSession) -> None:
    """Makes the scalar functions available to SQL of this session."""
    functions = {
        "wave_hann": ("i INT, n INT", "FLOAT", "cast(0.5D * (1 - cos(2 * pi() * i / n)) as float)"),
        "wave_freq_to_bin": ("freq FLOAT, resolution FLOAT, bins INT", "BIGINT", f"case when isnan(freq) then 0 else least(cast(least(greatest(cast(round(cast(freq / resolution as float)) as double), 0D), {U32_MAX}D) as bigint), bins - 1) end"),
        "wave_quantize_dt": ("dt FLOAT, resolution FLOAT", "BIGINT", f"case when isnan(dt) then 0 else cast(least(greatest(cast(round(cast(dt / resolution as float)) as double), 0D), {U32_MAX}D) as bigint) end"),
        "wave_pack_hash": ("f1 BIGINT, f2 BIGINT, dt BIGINT", "BIGINT", f"shiftleft(f1 & {FIELD_MASK}, 40) | shiftleft(f2 & {FIELD_MASK}, 20) | (dt & {FIELD_MASK})"),
        "wave_offset_to_bin": ("offset_ FLOAT, size FLOAT", "BIGINT", "cast(round(cast(offset_ / size as float)) as bigint)"),
        "wave_bin_to_offset": ("bin BIGINT, size FLOAT", "FLOAT", "cast(bin as float) * size"),
    }
    for name, (args, kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
