"""Decodes RIFF WAVE bytes: integer PCM of 8 to 32 bits, IEEE floats, and the extensible header."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

from ..errors import AudioTooShort, InvalidWavFormat

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass
class Decoded:
    """Mono samples, with the rate and channel count of the file."""

    samples: np.ndarray
    sample_rate: int
    original_channels: int

    def num_samples(self) -> int:
        return len(self.samples)

    def duration_secs(self) -> float:
        return float(np.float32(len(self.samples) / self.sample_rate)) if self.sample_rate else 0.0


def chunks(data: bytes, path: str) -> dict[bytes, bytes]:
    """The first chunk of each name; sizes are padded to even."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise InvalidWavFormat(f"{path}: no RIFF WAVE header")
    out, at = {}, 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"data" and at + 8 + size > len(data):
            raise InvalidWavFormat(f"{path}: the data chunk is cut short")
        out.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def raw_samples(data: bytes, kind: int, bits: int, path: str) -> np.ndarray:
    """Interleaved samples as floats; integers are divided by half their range."""
    width = bits // 8
    data = data[: len(data) // width * width] if width else data
    if kind == FLOAT and bits == 32:
        return np.frombuffer(data, "<f4").astype(np.float32)
    if kind != PCM or bits not in (8, 16, 24, 32):
        raise InvalidWavFormat(f"{path}: format {kind} with {bits} bits is not supported")
    if bits == 8:
        values = np.frombuffer(data, np.uint8).astype(np.int32) - 128
    elif bits == 24:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        values = (parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8
    else:
        values = np.frombuffer(data, f"<i{width}")
    return values.astype(np.float32) / np.float32(1 << (bits - 1))


def downmix(samples: np.ndarray, channels: int) -> np.ndarray:
    """Mean over channels in single precision; a last partial frame is dropped."""
    if channels <= 1:
        return samples
    rows = samples[: len(samples) // channels * channels].reshape(-1, channels)
    total = np.zeros(len(rows), np.float32)
    for c in range(channels):
        total += rows[:, c]
    return total / np.float32(channels)


@dataclass(frozen=True)
class Form:
    """How samples are stored: kind of number, bits, channels, rate."""

    kind: int
    bits: int
    channels: int
    rate: int

    @property
    def step(self) -> int:
        """Bytes of one sample of all channels."""
        return self.channels * (self.bits // 8)


def form_of(head: bytes, path: str) -> Form:
    """From a format chunk."""
    if len(head) < 16:
        raise InvalidWavFormat(f"{path}: no format chunk")
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head)
    if kind == EXTENSIBLE:
        if len(head) < 26:
            raise InvalidWavFormat(f"{path}: the extensible format chunk is cut short")
        (kind,) = struct.unpack_from("<H", head, 24)
    if not channels:
        raise InvalidWavFormat(f"{path}: no channels")
    return Form(kind, bits, channels, rate)


def decode(data: bytes, path: str) -> Decoded:
    found = chunks(data, path)
    form = form_of(found.get(b"fmt ", b""), path)
    if b"data" not in found:
        raise InvalidWavFormat(f"{path}: no data chunk")
    samples = raw_samples(found[b"data"], form.kind, form.bits, path)
    if not len(samples):
        raise AudioTooShort(path)
    return Decoded(downmix(samples, form.channels), form.rate, form.channels)


def located(file: BinaryIO, path: str) -> tuple[Form, int, int]:
    """Form, place and samples of an open file's data, from the heads of its chunks alone."""
    size = file.seek(0, 2)
    file.seek(0)
    start = file.read(12)
    if len(start) < 12 or start[:4] != b"RIFF" or start[8:] != b"WAVE":
        raise InvalidWavFormat(f"{path}: no RIFF WAVE header")
    head, data, at = b"", None, 12
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt " and not head:
            head = file.read(length)
        if name == b"data":
            if at + 8 + length > size:
                raise InvalidWavFormat(f"{path}: the data chunk is cut short")
            data = data or (at + 8, length)
        at += 8 + length + length % 2
    form = form_of(head, path)
    if data is None:
        raise InvalidWavFormat(f"{path}: no data chunk")
    raw_samples(b"", form.kind, form.bits, path)
    if data[1] < form.bits // 8:
        raise AudioTooShort(path)
    return form, data[0], data[1] // form.step


def samples_between(file: BinaryIO, form: Form, at: int, first: int, last: int, path: str) -> np.ndarray:
    """Mono samples first..last-1 of the data that starts at `at`."""
    file.seek(at + first * form.step)
    return downmix(raw_samples(file.read((last - first) * form.step), form.kind, form.bits, path), form.channels)
