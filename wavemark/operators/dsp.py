"""Numpy kernels: short-time spectra in decibels and strict two-dimensional maxima.

They work on runs of frames with a margin, so a track of any length takes bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..config import PipelineConfig
from ..functions import hann_weights

FRAMES = 1024


def frame_total(n: int, window: int, hop: int) -> int:
    return (n - window) // hop + 1 if n >= window else 0


def spectrum_db(samples: np.ndarray, window: int, hop: int, first: int, last: int, weights: np.ndarray) -> np.ndarray:
    """Levels of frames first..last-1: one row a frame, one column a bin. Windowed samples
    are single, and transformed in double precision, where the SQL form sums: levels that are equal in
    exact arithmetic, as in periodic signals, then stay equal once they are rounded to single."""
    view = np.lib.stride_tricks.sliding_window_view(samples, window)[first * hop : (last - 1) * hop + 1 : hop]
    frames = view * weights
    spectrum = np.fft.rfft(frames.astype(np.float64), axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    power += 1e-10
    np.log10(power, out=power)
    power *= 10
    return power.astype(np.float32, copy=False)


def sliding_max(x: np.ndarray, lo: int, hi: int, axis: int) -> np.ndarray:
    """Maximum over offsets lo..hi along an axis, -inf beyond its ends; widths double."""
    width = hi - lo + 1
    if width <= 0:
        return np.full_like(x, -np.inf)

    def part(m: np.ndarray, a: int, b: int) -> np.ndarray:
        return m[a:b] if axis == 0 else m[:, a:b]

    pad = [(0, 0), (0, 0)]
    pad[axis] = (max(0, -lo), max(0, hi))
    m, n, step = np.pad(x, pad, constant_values=-np.inf), x.shape[axis], 1
    while 2 * step <= width:
        size = m.shape[axis]
        m = np.maximum(part(m, 0, size - step), part(m, step, size))
        step *= 2
    start = max(0, -lo) + lo
    return np.maximum(part(m, start, start + n), part(m, start + width - step, start + width - step + n))


def strict_maxima(db: np.ndarray, t: int, f: int, threshold: float) -> np.ndarray:
    """Cells at or above the threshold and above every other cell of their neighbourhood, which is
    clipped at the edges. A cell that is not a number suppresses none and is never suppressed.

    Only cells that equal their row's neighbourhood maximum are looked at further, and each step
    to one side drops most of those that are left.
    """
    odd = np.isnan(db)
    level = np.where(odd, -np.inf, db).astype(db.dtype, copy=False) if odd.any() else db
    row = sliding_max(level, -f, f, 1)
    i, j = np.nonzero((level == row) & (level >= np.float32(threshold)))
    v = level[i, j]
    for grid, reach, step in ((row, t, (1, 0)), (level, f, (0, 1))):
        # What is beyond the edges is no number, and so above nothing.
        wide = np.full((grid.shape[0] + 2 * reach * step[0], grid.shape[1] + 2 * reach * step[1]), np.nan, grid.dtype)
        wide[reach * step[0] : reach * step[0] + grid.shape[0], reach * step[1] : reach * step[1] + grid.shape[1]] = grid
        for o in (s * k for k in range(1, reach + 1) for s in (1, -1)):
            lives = ~(wide[i + (reach + o) * step[0], j + (reach + o) * step[1]] >= v)
            i, j, v = i[lives], j[lives], v[lives]
    out = odd
    out[i, j] = True
    return out


def track_peaks(samples: np.ndarray, cfg: PipelineConfig, weights: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Frames, bins and levels of a track's peaks, in the order of frame and bin. Tasks of many tracks
    give the window's weights."""
    window, hop = cfg.spectrogram.window_size, cfg.spectrogram.hop_size
    weights = np.array(hann_weights(window), np.float32) if weights is None else weights
    total, t = frame_total(len(samples), window, hop), cfg.peaks.time_neighborhood
    for first in range(0, total, FRAMES):
        last = min(total, first + FRAMES)
        lo, hi = max(0, first - t), min(total, last + t)
        db = spectrum_db(samples, window, hop, lo, hi, weights)
        peaks = strict_maxima(db, t, cfg.peaks.freq_neighborhood, cfg.peaks.threshold_db)[first - lo : last - lo]
        frame, bin_ = np.nonzero(peaks)
        yield frame + first, bin_, db[frame + first - lo, bin_]
