"""Exceptions of the audio pipeline. All derive from WaveError; those about files are OSErrors too,
so callers may catch IOError."""

from __future__ import annotations


class WaveError(Exception):
    """Base of all errors of this package; `detail` completes the message."""

    template = "{0}"

    def __init__(self, detail: str = "") -> None:
        self.detail = detail
        super().__init__(self.template.format(detail))


class FileNotFound(WaveError, OSError):
    template = "no such file: {0}"


class FileNotReadable(WaveError, OSError):
    template = "cannot read {0}"


class InvalidWavFormat(WaveError, OSError):
    template = "not a WAV file that can be decoded: {0}"


class UnsupportedAudioFormat(WaveError, OSError):
    template = "not a kind of audio file that can be read: {0}"


class AudioTooShort(WaveError, OSError):
    template = "no samples in {0}"


class FftError(WaveError):
    """Kept for callers that name it; numpy's transform does not fail."""

    template = "transform failed: {0}"


class SpectrogramError(WaveError, RuntimeError):
    template = "cannot make a spectrogram: {0}"


class NoPeaksFound(WaveError):
    """Kept for callers that name it; audio without peaks has an empty fingerprint."""

    template = "no peaks in {0}"


class HashingError(WaveError):
    """Kept for callers that name it."""

    template = "cannot hash: {0}"


class IndexStoreError(WaveError, OSError):
    template = "index is damaged: {0}"


class StoreIoError(WaveError, OSError):
    template = "storage failed: {0}"
