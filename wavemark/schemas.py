"""Schemas of the tables that pass between operators."""

from __future__ import annotations

SIGNALS = "track_name string, samples array<float>, sample_rate int, original_channels smallint"
SIGNALS_PERMISSIVE = f"{SIGNALS}, path string, error string"
#: A run of frames first..last-1 of a track, with the samples from frame `start` on, which is before it.
CHUNKS = "track_name string, path string, first bigint, last bigint, start bigint, samples array<float>"
SPECTROGRAM = "track_name string, frame int, db array<float>"
CELLS = "track_name string, frame int, bin int, db float"
PEAKS = "track_name string, frame int, bin int, time float, freq float, amplitude float"
FINGERPRINTS = "track_name string, seq int, hash bigint, anchor_time float"
TRACKS = "track_id int, track_name string"
POSTINGS = "hash bigint, track_id int, anchor_time float"
RESULTS = "query_id string, track_id string, score bigint, offset_bin bigint, offset_secs float"
