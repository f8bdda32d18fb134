"""Settings of the pipeline. `PipelineConfig` derives what has to agree between the stages."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from .errors import SpectrogramError

#: The defaults of every stage.
SAMPLE_RATE, WINDOW, HOP = 22_050, 2048, 512


@dataclass(frozen=True)
class SpectrogramConfig:
    window_size: int = WINDOW
    hop_size: int = HOP

    def check(self) -> None:
        if self.window_size <= 0 or self.hop_size <= 0:
            raise SpectrogramError("window_size and hop_size must be greater than zero")

    def check_length(self, n: int) -> None:
        if n < self.window_size:
            raise SpectrogramError(f"audio has {n} samples, fewer than the window of {self.window_size}")

    @property
    def bins(self) -> int:
        return self.window_size // 2 + 1


@dataclass(frozen=True)
class PeakConfig:
    """Half-widths of the neighbourhood in frames and bins, and the least level of a peak."""

    time_neighborhood: int = 10
    freq_neighborhood: int = 10
    threshold_db: float = -40.0
    sample_rate: int = SAMPLE_RATE
    hop_size: int = HOP
    window_size: int = WINDOW

    @property
    def time_per_frame(self) -> float:
        return float(np.float32(self.hop_size) / np.float32(self.sample_rate))

    @property
    def freq_per_bin(self) -> float:
        return float(np.float32(self.sample_rate) / np.float32(self.window_size))


@dataclass(frozen=True)
class HashConfig:
    fan_value: int = 15
    min_dt: float = 0.0
    max_dt: float = 1.0
    freq_bins: int = 1024
    freq_resolution: float = SAMPLE_RATE / WINDOW
    dt_resolution: float = 0.01


@dataclass(frozen=True)
class IndexConfig:
    offset_bin_size: float = 0.05


@dataclass(frozen=True)
class PipelineConfig:
    """All stages. `derive` sets the rates and sizes that must agree from one place."""

    spectrogram: SpectrogramConfig = field(default_factory=SpectrogramConfig)
    peaks: PeakConfig = field(default_factory=PeakConfig)
    hashes: HashConfig = field(default_factory=HashConfig)
    index: IndexConfig = field(default_factory=IndexConfig)

    @classmethod
    def derive(cls, sample_rate: int = SAMPLE_RATE, window_size: int = WINDOW, hop_size: int = HOP, peaks: dict | None = None, hashes: dict | None = None, index: dict | None = None) -> PipelineConfig:
        return cls(
            SpectrogramConfig(window_size, hop_size),
            replace(PeakConfig(sample_rate=sample_rate, hop_size=hop_size, window_size=window_size), **(peaks or {})),
            replace(HashConfig(freq_resolution=sample_rate / window_size), **(hashes or {})),
            replace(IndexConfig(), **(index or {})),
        )


#: Settings recommended for kinds of audio.
PRESETS = {
    "default": PipelineConfig(),
    "speech": PipelineConfig.derive(peaks={"threshold_db": -30.0}, hashes={"max_dt": 2.0, "fan_value": 10}),
    "noisy": PipelineConfig.derive(peaks={"threshold_db": -25.0, "time_neighborhood": 15}),
    "short_clips": PipelineConfig.derive(hashes={"fan_value": 20}, index={"offset_bin_size": 0.01}),
    "large_database": PipelineConfig.derive(hashes={"fan_value": 10}),
}
