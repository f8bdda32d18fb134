"""Queries over the test tables, read as signals, with the same in DuckDB's SQL.

Signals: `emb` are embeddings of 64 samples; `evt` are each user's event values in order of time;
`doc` are the characters of a whole text as 8-bit samples; `std` are the same under the default
settings. Fingerprints come from the one-pass form and are written once for each query, so that
index, lookup and result read the same table; `*_emb` of spectrogram, peaks and fingerprints and
what is about single cells run the form in SQL operations. QUERIES maps names to functions of
(spark, sf_dir), SQL to their oracle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as W
from ..config import HashConfig, IndexConfig, PeakConfig, PipelineConfig
from ..functions.tables import register_tables
from ..operators import chunks, hashes, index, peaks, spectrogram
from ..shared import fresh_path, written
from ..sources import store
from ..sources.wav import decoded
from . import as_queries

EMB = PipelineConfig.derive(64, 16, 4, {"time_neighborhood": 2, "freq_neighborhood": 2, "threshold_db": -20.0}, {"max_dt": 0.5})
EVT = PipelineConfig.derive(64, 16, 4, {"time_neighborhood": 2, "freq_neighborhood": 2}, {"max_dt": 0.5})
DOC = PipelineConfig.derive(8000, 256, 128, {"time_neighborhood": 2, "freq_neighborhood": 4}, {"fan_value": 5, "max_dt": 0.5, "dt_resolution": 0.001})
CONFIGS = {"emb": EMB, "evt": EVT, "doc": DOC, "std": PipelineConfig()}


def signals(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """(track_name, samples) of a view."""
    if view == "emb":
        return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("track_name"), F.col("embedding").alias("samples"))
    if view == "evt":
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("x"))
        return rows.select(F.col("user_id").cast("string").alias("track_name"), F.transform("x", lambda e: (e["value"] / 512).cast("float")).alias("samples"))
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", chars.alias("chars"))
    return rows.select(F.col("doc_id").cast("string").alias("track_name"), F.transform("chars", lambda c: W.pcm_sample(F.ascii(c) - 128, 8)).alias("samples"))


def characters(text: pa.Scalar) -> np.ndarray:
    """The samples of a text, as `signals` gives them."""
    return ((np.frombuffer(text.as_py().encode("utf-32-le"), "<u4").astype(np.float64) - 128) / 128).astype(np.float32)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_name, samples) of the view of documents, as texts that `characters` reads in the task."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("track_name"), F.col("text").alias("samples"))


def _cells(spark: SparkSession, d: str, view: str) -> DataFrame:
    return spectrogram.cells(signals(spark, d, view), CONFIGS[view].spectrogram)


def _peaks_of_cells(spark: SparkSession, d: str, view: str) -> DataFrame:
    return peaks.peaks_from_cells(_cells(spark, d, view), CONFIGS[view].peaks)


def _peaks(spark: SparkSession, d: str, view: str) -> DataFrame:
    if view in ("doc", "std"):
        return peaks.peaks_from_signals(_texts(spark, d), CONFIGS[view], characters)
    return peaks.peaks_from_signals(signals(spark, d, view), CONFIGS[view])


def _prints_of(rows: DataFrame, view: str, cfg: HashConfig | None = None) -> DataFrame:
    """Fingerprints of signals in one pass, written once."""
    return written(hashes.fingerprints_from_signals(rows, replace(CONFIGS[view], hashes=cfg or CONFIGS[view].hashes)), "prints")


def _prints(spark: SparkSession, d: str, view: str, cfg: HashConfig | None = None) -> DataFrame:
    return _prints_of(signals(spark, d, view), view, cfg)


def _index(prints: DataFrame) -> index.FingerprintIndex:
    return index.FingerprintIndex.build(prints)


def _asked(prints: DataFrame) -> DataFrame:
    """The prints of every tenth track, as queries: a set asked against all rows."""
    return as_queries(prints.filter(F.col("track_name").cast("long") % 10 == 0))


def _d(c: str | Column, digits: int = 4) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


# --- SQL -----------------------------------------------------------------------------------------

SIG = {
    "emb": "sig AS (SELECT CAST(vec_id AS VARCHAR) AS track_name, embedding AS samples FROM embeddings)",
    "evt": "sig AS (SELECT CAST(user_id AS VARCHAR) AS track_name, list((value / 512)::FLOAT ORDER BY ts) AS samples FROM events GROUP BY user_id)",
    "doc": "sig AS (SELECT CAST(doc_id AS VARCHAR) AS track_name, list_transform(string_split(text, ''), lambda c: ((unicode(c) - 128) / 128)::FLOAT) AS samples FROM documents)",
}
SIG["std"] = SIG["doc"]


def _sql_cells(view: str) -> str:
    c = CONFIGS[view].spectrogram
    w, h = c.window_size, c.hop_size
    return f"""{SIG[view]},
hl AS (SELECT list((0.5 * (1 - cos(2 * pi() * range / {w})))::FLOAT ORDER BY range) AS h FROM range({w})),
fr AS (SELECT track_name, unnest(range(0, (len(samples) - {w}) // {h} + 1))::INT AS frame, samples FROM sig WHERE len(samples) >= {w}),
wv AS (SELECT track_name, frame, list_transform(samples[frame * {h} + 1 : frame * {h} + {w}], lambda x, i: x * h[i])::DOUBLE[] AS v FROM fr, hl),
waves AS (SELECT b.range::INT AS bin, list(cos(2 * pi() * b.range * j.range / {w}) ORDER BY j.range) AS c, list(sin(2 * pi() * b.range * j.range / {w}) ORDER BY j.range) AS s FROM range({w // 2 + 1}) b, range({w}) j GROUP BY ALL),
sums AS (SELECT track_name, frame, bin, list_dot_product(v, c) AS re, list_dot_product(v, s) AS im FROM wv, waves),
cells AS (SELECT track_name, frame, bin, (10 * log10(re * re + im * im + 1e-10))::FLOAT AS db FROM sums)"""


def _sql_peaks(view: str, cfg: PeakConfig | None = None) -> str:
    p = cfg or CONFIGS[view].peaks
    t, f = p.time_neighborhood, p.freq_neighborhood
    low = "'-infinity'::FLOAT"
    row, col = "PARTITION BY track_name, frame ORDER BY bin ROWS BETWEEN", "PARTITION BY track_name, bin ORDER BY frame ROWS BETWEEN"
    return f"""{_sql_cells(view)},
rows1 AS (
    SELECT *, max(db) OVER ({row} {f} PRECEDING AND {f} FOLLOWING) AS near,
        greatest(coalesce(max(db) OVER ({row} {f} PRECEDING AND 1 PRECEDING), {low}), coalesce(max(db) OVER ({row} 1 FOLLOWING AND {f} FOLLOWING), {low})) AS beside
    FROM cells
),
rows2 AS (
    SELECT *, greatest(coalesce(max(near) OVER ({col} {t} PRECEDING AND 1 PRECEDING), {low}), coalesce(max(near) OVER ({col} 1 FOLLOWING AND {t} FOLLOWING), {low})) AS around FROM rows1
),
peaks AS (
    SELECT track_name, frame, bin, frame::FLOAT * {p.time_per_frame!r}::FLOAT AS time, bin::FLOAT * {p.freq_per_bin!r}::FLOAT AS freq, db AS amplitude
    FROM rows2 WHERE db >= {p.threshold_db}::FLOAT AND db > beside AND db > around
)"""


def _sql_prints(view: str, cfg: HashConfig | None = None) -> str:
    c = cfg or CONFIGS[view].hashes
    near = f"AND b.seq <= a.seq + {c.fan_value} " if c.min_dt <= 0 else ""  # then no target is skipped
    return f"""{_sql_peaks(view)},
seqs AS (SELECT *, row_number() OVER (PARTITION BY track_name ORDER BY time, frame, bin) - 1 AS seq FROM peaks),
pairs AS (
    SELECT a.track_name, a.seq, a.time, a.freq AS f1, b.freq AS f2, b.time - a.time AS dt, row_number() OVER (PARTITION BY a.track_name, a.seq ORDER BY b.seq) AS place
    FROM seqs a JOIN seqs b ON a.track_name = b.track_name AND b.seq > a.seq {near}AND b.time - a.time >= {c.min_dt}::FLOAT AND b.time - a.time <= {c.max_dt}::FLOAT
),
prints AS (
    SELECT track_name, seq, (least(round(f1 / {W.f32(c.freq_resolution)!r}::FLOAT)::BIGINT, {c.freq_bins - 1}) << 40)
        | (least(round(f2 / {W.f32(c.freq_resolution)!r}::FLOAT)::BIGINT, {c.freq_bins - 1}) << 20) | round(dt / {W.f32(c.dt_resolution)!r}::FLOAT)::BIGINT AS hash, time AS anchor_time
    FROM pairs WHERE place <= {c.fan_value}
)"""


def _sql_votes(view: str, cfg: HashConfig | None = None, size: float = IndexConfig().offset_bin_size) -> str:
    return f"""{_sql_prints(view, cfg)},
asked AS (SELECT track_name AS query_id, hash, anchor_time FROM prints WHERE track_name::BIGINT % 10 = 0),
votes AS (
    SELECT query_id, track_name AS track_id, round((p.anchor_time - q.anchor_time) / {W.f32(size)!r}::FLOAT)::BIGINT AS offset_bin, count(*) AS score
    FROM asked q JOIN prints p USING (hash) GROUP BY ALL
),
tops AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY query_id, track_id ORDER BY score DESC, offset_bin) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id, offset_bin) AS rank FROM tops)"""


SECONDS = f"round((offset_bin::FLOAT * {W.f32(0.05)!r}::FLOAT)::DOUBLE, 4) AS offset_secs"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


@_query("hann_window", "SELECT range::INT AS i, round((0.5 * (1 - cos(2 * pi() * range / 16)))::FLOAT::DOUBLE, 6) AS w FROM range(16)")
def hann(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(W.hann_window(16)).alias("i", "x")).select("i", _d("x", 6).alias("w"))


@_query("normalize_pcm", f"WITH {SIG['doc']} SELECT track_name, len(samples)::INT AS n, round(list_min(samples)::DOUBLE, 6) AS lo, round(list_max(samples)::DOUBLE, 6) AS hi FROM sig")
def normalize_pcm(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d, "doc").select("track_name", F.size("samples").alias("n"), _d(F.array_min("samples"), 6).alias("lo"), _d(F.array_max("samples"), 6).alias("hi"))


@_query("downmix_stereo", f"WITH {SIG['evt']}, f AS (SELECT track_name, samples, unnest(range(0, len(samples) // 2))::INT AS pos FROM sig) SELECT track_name, pos, round(((samples[2 * pos + 1] + samples[2 * pos + 2]) / 2::FLOAT)::DOUBLE, 6) AS sample FROM f")
def downmix_stereo(spark: SparkSession, d: str) -> DataFrame:
    rows = signals(spark, d, "evt").select("track_name", F.posexplode(W.downmixed(F.col("samples"), 2)).alias("pos", "x"))
    return rows.select("track_name", "pos", _d("x", 6).alias("sample"))


@_query("signal_stats", f"WITH {SIG['evt']} SELECT track_name, len(samples)::INT AS num_samples, round((len(samples) / 64)::FLOAT::DOUBLE, 4) AS duration FROM sig")
def signal_stats(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d, "evt").select("track_name", F.size("samples").alias("num_samples"), _d(W.duration_secs(F.col("samples"), F.lit(64))).alias("duration"))


@_query("frame_signal", f"WITH {SIG['emb']}, f AS (SELECT track_name, samples, unnest(range(0, (len(samples) - 16) // 4 + 1))::INT AS frame FROM sig WHERE len(samples) >= 16) SELECT track_name, frame, round(samples[frame * 4 + 1]::DOUBLE, 6) AS first, round(samples[frame * 4 + 16]::DOUBLE, 6) AS last FROM f")
def frame_signal(spark: SparkSession, d: str) -> DataFrame:
    rows = spectrogram.frames(signals(spark, d, "emb"), EMB.spectrogram)
    return rows.select("track_name", "frame", _d(F.get("samples", F.lit(0)), 6).alias("first"), _d(F.get("samples", F.lit(15)), 6).alias("last"))


@_query("windowed_frames", f"WITH {_sql_cells('emb')} SELECT track_name, frame, round(list_dot_product(v, v), 6) AS energy FROM wv")
def windowed_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = spectrogram.windowed_frames(signals(spark, d, "emb"), EMB.spectrogram)
    energy = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return rows.select("track_name", "frame", F.round(energy, 6).alias("energy"))


for _view in ("emb", "evt"):

    @_query(f"spectrogram_db_{_view}", f"WITH {_sql_cells(_view)} SELECT track_name, frame, bin, round(db::DOUBLE, 4) AS db FROM cells")
    def spectrogram_db(spark: SparkSession, d: str, view: str = _view) -> DataFrame:
        rows = _cells(spark, d, view) if view == "emb" else spectrogram.to_cells(spectrogram.spectrogram(signals(spark, d, view), CONFIGS[view].spectrogram))
        return rows.select("track_name", "frame", "bin", _d("db").alias("db"))

    @_query(f"peaks_{_view}", f"WITH {_sql_peaks(_view)} SELECT track_name, frame, bin, round(amplitude::DOUBLE, 4) AS amplitude FROM peaks")
    def peaks_query(spark: SparkSession, d: str, view: str = _view) -> DataFrame:
        rows = _peaks_of_cells(spark, d, view) if view == "emb" else _peaks(spark, d, view)
        return rows.select("track_name", "frame", "bin", _d("amplitude").alias("amplitude"))

    @_query(f"fingerprints_{_view}", f"WITH {_sql_prints(_view)} SELECT track_name, seq::INT AS seq, hash, round(anchor_time::DOUBLE, 4) AS anchor_time FROM prints")
    def fingerprints_query(spark: SparkSession, d: str, view: str = _view) -> DataFrame:
        rows = hashes.fingerprints(_peaks_of_cells(spark, d, view), CONFIGS[view].hashes) if view == "emb" else _prints(spark, d, view)
        return rows.select("track_name", "seq", "hash", _d("anchor_time").alias("anchor_time"))


@_query("spectrogram_table_evt", SQL["spectrogram_db_evt"])
def spectrogram_table(spark: SparkSession, d: str) -> DataFrame:
    """The table function of SQL, over tracks that come in pieces of 40 samples."""
    register_tables(spark)
    place = F.posexplode(F.sequence(F.lit(0), F.greatest(F.floor((F.size("samples") - 1) / 40), F.lit(0)).cast("int")))
    pieces = signals(spark, d, "evt").select("track_name", "samples", place.alias("place", "i")).select("track_name", "place", F.slice("samples", F.col("i") * 40 + 1, F.lit(40)).alias("samples"))
    cfg = EVT.spectrogram
    rows = spark.sql(f"SELECT * FROM wave_spectrogram(TABLE({{pieces}}) PARTITION BY (track_name) ORDER BY (place), {cfg.window_size}, {cfg.hop_size})", pieces=pieces)
    return spectrogram.to_cells(rows).select("track_name", "frame", "bin", _d("db").alias("db"))


@_query("peaks_chunked_evt", SQL["peaks_evt"])
def peaks_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of tracks cut in runs of 50 frames, each with what it needs from its neighbours."""
    rows = chunks.peaks_from_chunks(chunks.split_signals(signals(spark, d, "evt"), EVT, 50), EVT)
    return rows.select("track_name", "frame", "bin", _d("amplitude").alias("amplitude"))


@_query("fingerprints_chunked_evt", SQL["fingerprints_evt"])
def prints_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of such runs; anchors are numbered over the whole track."""
    rows = chunks.fingerprints_from_chunks(chunks.split_signals(signals(spark, d, "evt"), EVT, 50), EVT)
    return rows.select("track_name", "seq", "hash", _d("anchor_time").alias("anchor_time"))


@_query("spectrogram_loudest_bin", f"WITH {_sql_cells('emb')} SELECT track_name, frame, bin FROM cells QUALIFY row_number() OVER (PARTITION BY track_name, frame ORDER BY db DESC, bin) = 1")
def loudest(spark: SparkSession, d: str) -> DataFrame:
    rows = _cells(spark, d, "emb").groupBy("track_name", "frame").agg(F.max(F.struct("db", -F.col("bin"))).alias("x"))
    return rows.select("track_name", "frame", (-F.col("x.col2")).alias("bin"))


@_query("threshold_cells", f"WITH {_sql_cells('emb')} SELECT track_name, frame, bin FROM cells WHERE db >= -20::FLOAT")
def threshold_cells(spark: SparkSession, d: str) -> DataFrame:
    return peaks.above_threshold(_cells(spark, d, "emb"), EMB.peaks).select("track_name", "frame", "bin")


@_query("peaks_fft_emb", f"WITH {_sql_peaks('emb')} SELECT track_name, frame, bin, round(amplitude::DOUBLE, 3) AS amplitude FROM peaks")
def peaks_fft(spark: SparkSession, d: str) -> DataFrame:
    """The vectorised form finds the same peaks."""
    return _peaks(spark, d, "emb").select("track_name", "frame", "bin", _d("amplitude", 3).alias("amplitude"))


@_query("peaks_sorted_seq", f"WITH {_sql_prints('emb')} SELECT track_name, seq::INT AS seq, frame, bin FROM seqs")
def peaks_sorted(spark: SparkSession, d: str) -> DataFrame:
    return peaks.sequenced(_peaks(spark, d, "emb")).select("track_name", "seq", "frame", "bin")


@_query("peak_coordinates", f"WITH {_sql_peaks('doc')} SELECT track_name, frame, bin, round(time::DOUBLE, 6) AS time, round(freq::DOUBLE, 4) AS freq FROM peaks")
def peak_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return _peaks(spark, d, "doc").select("track_name", "frame", "bin", _d("time", 6).alias("time"), _d("freq").alias("freq"))


@_query("freq_to_bin", "SELECT event_id, least(greatest(round(value::FLOAT / 10.766602::FLOAT), 0)::BIGINT, 1023) AS bin FROM events")
def freq_to_bin(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", W.freq_to_bin(F.col("value").cast("float"), 10.766602, 1024).alias("bin"))


@_query("quantize_dt", f"SELECT event_id, greatest(round((value / 512)::FLOAT / {W.f32(0.01)!r}::FLOAT), 0)::BIGINT AS dt FROM events")
def quantize_dt(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", W.quantize_dt((F.col("value") / 512).cast("float"), 0.01).alias("dt"))


@_query("pack_hash", "SELECT event_id, ((event_id & 1048575) << 40) | ((user_id & 1048575) << 20) | (floor(value)::BIGINT & 1048575) AS hash FROM events")
def pack(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", W.pack_hash(F.col("event_id"), F.col("user_id"), F.floor("value")).alias("hash"))


@_query("unpack_hash", f"WITH {_sql_prints('emb')} SELECT track_name, seq::INT AS seq, (hash >> 40) & 1048575 AS f1, (hash >> 20) & 1048575 AS f2, hash & 1048575 AS dt FROM prints")
def unpack(spark: SparkSession, d: str) -> DataFrame:
    f1, f2, dt = W.unpack_hash(F.col("hash"))
    return _prints(spark, d, "emb").select("track_name", "seq", f1.alias("f1"), f2.alias("f2"), dt.alias("dt"))


MIN_DT = HashConfig(5, 0.1, 0.5, 1024, 4.0, 0.01)
SMALL_FAN = HashConfig(2, 0.0, 0.5, 1024, 4.0, 0.01)


@_query("fingerprints_min_dt", f"WITH {_sql_prints('emb', MIN_DT)} SELECT track_name, seq::INT AS seq, hash, round(anchor_time::DOUBLE, 4) AS anchor_time FROM prints")
def prints_min_dt(spark: SparkSession, d: str) -> DataFrame:
    return _prints(spark, d, "emb", MIN_DT).select("track_name", "seq", "hash", _d("anchor_time").alias("anchor_time"))


@_query("fingerprints_small_fan", f"WITH {_sql_prints('emb', SMALL_FAN)} SELECT track_name, seq::INT AS seq, count(*) AS n FROM prints GROUP BY ALL")
def prints_small_fan(spark: SparkSession, d: str) -> DataFrame:
    return _prints(spark, d, "emb", SMALL_FAN).groupBy("track_name", "seq").agg(F.count("*").alias("n"))


@_query("hash_collision_rate", f"WITH {_sql_prints('evt')}, s AS (SELECT DISTINCT track_name, hash FROM prints) SELECT hash, count(*) AS n_tracks FROM s GROUP BY hash HAVING count(*) > 1")
def collisions(spark: SparkSession, d: str) -> DataFrame:
    return _prints(spark, d, "evt").select("track_name", "hash").distinct().groupBy("hash").agg(F.count("*").alias("n_tracks")).filter("n_tracks > 1")


@_query("hash_set_intersection", f"WITH {_sql_prints('evt')} SELECT hash FROM prints WHERE track_name::BIGINT % 2 = 0 INTERSECT SELECT hash FROM prints WHERE track_name::BIGINT % 2 = 1")
def intersection(spark: SparkSession, d: str) -> DataFrame:
    rows, parity = _prints(spark, d, "evt"), F.col("track_name").cast("long") % 2
    return rows.filter(parity == 0).select("hash").intersect(rows.filter(parity == 1).select("hash"))


@_query("track_dictionary", f"WITH {SIG['emb']} SELECT (row_number() OVER (ORDER BY substr(md5(track_name), 1, 3), track_name) - 1)::INT AS track_id, track_name FROM sig")
def dictionary(spark: SparkSession, d: str) -> DataFrame:
    return index.numbered(signals(spark, d, "emb"))


@_query("index_counts", f"WITH {_sql_prints('emb')} SELECT (SELECT count(DISTINCT track_name) FROM prints) AS tracks, (SELECT count(*) FROM prints) AS hashes")
def counts(spark: SparkSession, d: str) -> DataFrame:
    held = _index(_prints(spark, d, "emb"))
    return held.tracks.agg(F.count("*").alias("tracks")).crossJoin(held.postings.agg(F.count("*").alias("hashes")))


@_query("posting_lists", f"WITH {_sql_prints('emb')} SELECT hash, count(*) AS n_postings, count(DISTINCT track_name) AS n_tracks FROM prints GROUP BY hash")
def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    return _index(_prints(spark, d, "emb")).posting_lists()


@_query("index_append_duplicate", f"WITH {_sql_prints('emb')} SELECT track_name, count(*) * CASE WHEN track_name::BIGINT < 5 THEN 2 ELSE 1 END AS hashes FROM prints GROUP BY track_name")
def append_duplicate(spark: SparkSession, d: str) -> DataFrame:
    rows = _prints(spark, d, "emb")
    held = _index(rows).insert(rows.filter(F.col("track_name").cast("long") < 5))
    return held.postings.join(held.tracks, "track_id").groupBy("track_name").agg(F.count("*").alias("hashes"))


@_query("offset_histogram", f"WITH {_sql_votes('emb')} SELECT query_id, track_id, offset_bin, score FROM votes")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = _prints(spark, d, "emb")
    return _index(rows).named_histogram(_asked(rows)).withColumnRenamed("track_name", "track_id")


for _view in ("emb", "evt", "doc"):

    @_query(f"identify_{_view}", f"WITH {_sql_votes(_view)} SELECT query_id, track_id, score, offset_bin, {SECONDS} FROM ranked WHERE rank = 1")
    def identify_query(spark: SparkSession, d: str, view: str = _view) -> DataFrame:
        rows = _prints(spark, d, view)
        return _index(rows).query_batch(_asked(rows)).withColumn("offset_secs", _d("offset_secs"))



@_query("identify_topk", f"WITH {_sql_votes('evt')} SELECT query_id, track_id, score, offset_bin, {SECONDS}, rank FROM ranked WHERE rank <= 3")
def topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _prints(spark, d, "evt")
    return _index(rows).query_batch(_asked(rows), top_k=3).withColumn("offset_secs", _d("offset_secs")).withColumn("rank", F.col("rank").cast("long"))


@_query("identify_min_score", f"WITH {_sql_votes('evt')}, n AS (SELECT track_name AS query_id FROM sig WHERE track_name::BIGINT % 10 = 0) SELECT query_id, track_id, score, CASE WHEN score IS NULL THEN 'no_match' WHEN score < 10 THEN 'low_confidence' ELSE 'match' END AS status FROM n LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) USING (query_id)")
def min_score(spark: SparkSession, d: str) -> DataFrame:
    rows = _prints(spark, d, "evt")
    names = signals(spark, d, "evt").filter(F.col("track_name").cast("long") % 10 == 0).select(F.col("track_name").alias("query_id"))
    return _index(rows).identify(_asked(rows), names, 10).select("query_id", "track_id", "score", "status")


@_query("offset_histogram_common", f"""WITH {_sql_prints('emb')}, p AS (SELECT track_name, anchor_time, CASE WHEN seq % 4 = 0 THEN 7 ELSE hash END AS hash FROM prints),
asked AS (SELECT * FROM p WHERE track_name::BIGINT % 10 = 0)
SELECT q.track_name AS query_id, p.track_name, round((p.anchor_time - q.anchor_time) / {W.f32(0.05)!r}::FLOAT)::BIGINT AS offset_bin, count(*) AS score FROM asked q JOIN p USING (hash) GROUP BY ALL""")
def common_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Votes where one fingerprint is a quarter of all rows on both sides."""
    common = F.when(F.col("seq") % 4 == 0, F.lit(7).cast("long")).otherwise(F.col("hash"))
    rows = written(_prints(spark, d, "emb").withColumn("hash", common), "common-prints")
    return _index(rows).named_histogram(_asked(rows))


@_query("identify_no_match", "SELECT 'q' AS query_id, 'no_match' AS status")
def no_match(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([("q", -1, 0.0)], "query_id string, hash long, anchor_time float")
    return _index(_prints(spark, d, "emb")).identify(asked, asked).select("query_id", "status")


@_query("semi_join_prune", f"WITH {_sql_votes('emb')} SELECT hash, count(*) AS n FROM prints WHERE hash IN (SELECT hash FROM asked) GROUP BY hash")
def prune(spark: SparkSession, d: str) -> DataFrame:
    rows = _prints(spark, d, "emb")
    return _index(rows).pruned(_asked(rows)).groupBy("hash").agg(F.count("*").alias("n"))


def _sql_clip() -> str:
    """The evt chain on signals without their first 4 hops, as queries against the whole signals."""
    whole = _sql_prints("evt")
    cut = _sql_prints("evt").replace("list((value / 512)::FLOAT ORDER BY ts) AS samples", "list((value / 512)::FLOAT ORDER BY ts)[17:] AS samples")
    return f"""WITH w AS (WITH {whole} SELECT * FROM prints), c AS (WITH {cut} SELECT * FROM prints),
votes AS (SELECT c.track_name AS query_id, w.track_name AS track_id, round((w.anchor_time - c.anchor_time) / {W.f32(0.05)!r}::FLOAT)::BIGINT AS offset_bin, count(*) AS score FROM c JOIN w USING (hash) GROUP BY ALL)
SELECT query_id, track_id, score, offset_bin, {SECONDS} FROM votes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id, offset_bin) = 1"""


@_query("identify_clip_offset", _sql_clip())
def clip_offset(spark: SparkSession, d: str) -> DataFrame:
    whole = signals(spark, d, "evt")
    clips = whole.select("track_name", F.expr("slice(samples, 17, greatest(size(samples) - 16, 0))").alias("samples"))
    return _index(_prints_of(whole, "evt")).query_batch(as_queries(_prints_of(clips, "evt"))).withColumn("offset_secs", _d("offset_secs"))


@_query("save_load_roundtrip", f"WITH {_sql_prints('emb')} SELECT count(DISTINCT track_name) AS tracks, count(*) AS hashes FROM prints")
def save_load(spark: SparkSession, d: str) -> DataFrame:
    """Saved twice to the shared folder, then loaded: the counts stay."""
    path = fresh_path(spark, "index")
    store.save(_index(_prints(spark, d, "emb")), path)
    store.save(store.load(spark, path), path)
    held = store.load(spark, path)
    return held.tracks.agg(F.count("*").alias("tracks")).crossJoin(held.postings.agg(F.count("*").alias("hashes")))


@_query("store_append_query", f"WITH {_sql_votes('emb')} SELECT query_id, track_id, score, offset_bin, {SECONDS} FROM ranked WHERE rank = 1")
def append_and_query(spark: SparkSession, d: str) -> DataFrame:
    """Half of the tracks saved, the other half appended on disk, and the index asked where it lies."""
    rows, path = _prints(spark, d, "emb"), fresh_path(spark, "index")
    even = F.col("track_name").cast("long") % 2 == 0
    store.save(_index(rows.filter(even)), path)
    store.append(spark, path, rows.filter(~even))
    return store.query_store(spark, path, _asked(rows)).withColumn("offset_secs", _d("offset_secs"))


@_query("store_levels_query", f"WITH {_sql_votes('emb')} SELECT query_id, track_id, score, offset_bin, {SECONDS} FROM ranked WHERE rank <= 2")
def levels_query(spark: SparkSession, d: str) -> DataFrame:
    """Tracks that come in four parts, merged by pairs as levels fill, in shards of 2,000 postings."""
    rows, path = _prints(spark, d, "emb"), fresh_path(spark, "index")
    for k in range(4):
        store.append(spark, path, rows.filter(F.col("track_name").cast("long") % 4 == k), layout=store.Layout(shard_rows=2_000, level_rows=1_000, fanout=2))
    return store.query_store(spark, path, _asked(rows), top_k=2).drop("rank").withColumn("offset_secs", _d("offset_secs"))


@_query("store_pruned_postings", f"WITH {_sql_prints('emb')} SELECT hash, track_name, count(*) AS postings FROM prints WHERE hash IN (SELECT hash FROM prints WHERE track_name::BIGINT % 10 = 0) GROUP BY ALL")
def pruned_postings(spark: SparkSession, d: str) -> DataFrame:
    """What a set of fingerprints hits on disk, read from the shards of these alone."""
    rows, path = _prints(spark, d, "emb"), fresh_path(spark, "index")
    store.save(_index(rows), path, store.Layout(shard_rows=1_000))
    held = store.hit_postings(spark, path, _asked(rows))
    return held.postings.join(held.tracks, "track_id").groupBy("hash", "track_name").agg(F.count("*").alias("postings"))


@_query("store_silent_tracks", f"WITH {_sql_prints('emb')} SELECT vec_id::VARCHAR AS track_name, (SELECT count(*) FROM prints p WHERE p.track_name = vec_id::VARCHAR AND vec_id % 3 = 0) AS hashes FROM embeddings")
def silent_tracks(spark: SparkSession, d: str) -> DataFrame:
    """An index made where there is none, then filled; tracks without fingerprints are still there when
    it is opened again."""
    rows, path = _prints(spark, d, "emb"), fresh_path(spark, "index")
    store.open_or_create(spark, path)
    store.append(spark, path, rows.filter(F.col("track_name").cast("long") % 3 == 0), signals(spark, d, "emb"))
    held = store.open_or_create(spark, path)
    counts = held.postings.groupBy("track_id").agg(F.count("*").alias("n"))
    return held.tracks.join(counts, "track_id", "left").select("track_name", F.coalesce("n", F.lit(0)).alias("hashes"))


@_query("index_new_ids", f"""WITH {_sql_prints('emb')}, n AS (SELECT DISTINCT track_name, track_name::BIGINT >= 5 AS late FROM prints)
SELECT (row_number() OVER (PARTITION BY late ORDER BY substr(md5(track_name), 1, 3), track_name) - 1 + CASE WHEN late THEN (SELECT count(*) FROM n WHERE NOT late) ELSE 0 END)::INT AS track_id, track_name FROM n""")
def new_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of tracks that come later go on from the last."""
    rows = _prints(spark, d, "emb")
    late = F.col("track_name").cast("long") >= 5
    return _index(rows.filter(~late)).insert(rows.filter(late)).tracks


@_query("fingerprints_default", f"WITH {_sql_prints('std')} SELECT track_name, seq::INT AS seq, hash, round(anchor_time::DOUBLE, 4) AS anchor_time FROM prints")
def prints_default(spark: SparkSession, d: str) -> DataFrame:
    """The default settings: windows of 2048, fan of 15."""
    return _prints(spark, d, "std").select("track_name", "seq", "hash", _d("anchor_time").alias("anchor_time"))


@_query("constellation_evt", """WITH p AS (
    SELECT user_id::VARCHAR AS track_name, event_id, date_diff('second', min(ts) OVER (PARTITION BY user_id), ts)::FLOAT AS time, value::FLOAT AS freq FROM events
), s AS (SELECT *, row_number() OVER (PARTITION BY track_name ORDER BY time, freq) - 1 AS seq FROM p)
SELECT a.track_name, a.seq::INT AS seq, count(*) AS n FROM s a JOIN s b ON a.track_name = b.track_name AND b.seq > a.seq AND b.seq <= a.seq + 3 AND b.time - a.time <= 86400::FLOAT GROUP BY ALL""")
def constellation(spark: SparkSession, d: str) -> DataFrame:
    """Peaks given as such, without a spectrogram: events as a constellation. Times are between whole
    seconds of the clock, as date_diff counts, not whole seconds that have passed."""
    ts = F.date_trunc("SECOND", F.col("ts"))
    first = F.min(ts).over(Window.partitionBy("user_id"))
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("track_name"), F.timestamp_diff("SECOND", first, ts).cast("float").alias("time"), F.col("value").cast("float").alias("freq"))
    return hashes.fan_pairs(rows, HashConfig(3, 0.0, 86400.0)).groupBy("track_name", F.col("seq").cast("int").alias("seq")).agg(F.count("*").alias("n"))


#: Sample formats: bits, channels, floats.
FORMS = ((8, 1, False), (16, 1, False), (24, 1, False), (32, 1, False), (32, 1, True), (16, 2, False))


def _wav_bytes(x: np.ndarray, bits: int, channels: int, floats: bool) -> bytes:
    """A WAV file at 64 Hz; of two channels the second is silent."""
    if floats:
        raw = x.astype("<f4").tobytes()
    else:
        top = 1 << (bits - 1)
        v = np.clip(np.rint(x.astype(np.float64) * (top - 1)), -top, top - 1).astype(np.int64)
        v = np.column_stack([v, np.zeros_like(v)]).reshape(-1) if channels == 2 else v
        raw = (v + 128).astype(np.uint8).tobytes() if bits == 8 else v.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()
    step = channels * bits // 8
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, 3 if floats else 1, channels, 64, 64 * step, step, bits, b"data", len(raw)) + raw


def _wav_files(spark: SparkSession, d: str, forms: tuple, damage: bool = False) -> DataFrame:
    """(path, content): each signal as a file, in the form of its number; two thirds damaged if asked."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, files = batch.column(0).to_pylist(), []
            for name, x in zip(names, batch.column(1), strict=True):
                content = _wav_bytes(x.values.to_numpy(), *forms[int(name) % len(forms)])
                files.append({0: content, 1: content[:50], 2: b"JUNK" + content[4:]}[int(name) % 3] if damage else content)
            yield pa.RecordBatch.from_arrays([pa.array([f"/memory/{name}.wav" for name in names]), pa.array(files, pa.binary())], ["path", "content"])

    return signals(spark, d, "emb").mapInArrow(make, "path string, content binary")


@_query("wav_decode_roundtrip", f"WITH {SIG['emb']} SELECT track_name, len(samples)::INT AS num_samples, 64 AS sample_rate, list_sum(list_transform(samples, lambda x: round(x::DOUBLE * 32767))) AS total, NULL::VARCHAR AS error FROM sig")
def wav_decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Signals packed as 16-bit WAV bytes and decoded again by the WAV reader."""
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + F.round(x * 32768).cast("double"))
    return decoded(_wav_files(spark, d, FORMS[1:2])).select("track_name", F.size("samples").cast("int").alias("num_samples"), "sample_rate", _d(total, 0).alias("total"), "error")


def _sql_widths() -> str:
    kinds = [f"WHEN {i} THEN (round_even(x::DOUBLE * {2 ** (b - 1) - 1}, 0)::FLOAT / {2 ** (b - 1)}::FLOAT)::DOUBLE / {n}" for i, (b, n, floats) in enumerate(FORMS) if not floats]
    return f"WITH {SIG['emb']} SELECT track_name, len(samples)::INT AS num_samples, CASE WHEN track_name::BIGINT % 6 = 5 THEN 2 ELSE 1 END AS channels, round(list_sum(list_transform(samples, lambda x: CASE track_name::BIGINT % 6 {' '.join(kinds)} ELSE x::DOUBLE END)), 3) + 0.0 AS total FROM sig"


@_query("wav_widths", _sql_widths())
def wav_widths(spark: SparkSession, d: str) -> DataFrame:
    """8, 16, 24 and 32 bits, floats, and two channels."""
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return decoded(_wav_files(spark, d, FORMS)).select("track_name", F.size("samples").alias("num_samples"), F.col("original_channels").cast("int").alias("channels"), (_d(total, 3) + 0.0).alias("total"))


@_query("wav_permissive", f"WITH {SIG['emb']} SELECT track_name, track_name::BIGINT % 3 = 0 AS good, CASE WHEN track_name::BIGINT % 3 = 0 THEN len(samples)::INT ELSE 0 END AS num_samples FROM sig")
def wav_permissive(spark: SparkSession, d: str) -> DataFrame:
    """Damaged files keep an error, and the others are read."""
    rows = decoded(_wav_files(spark, d, FORMS, damage=True))
    return rows.select("track_name", F.col("error").isNull().alias("good"), F.when(F.col("error").isNull(), F.size("samples")).otherwise(0).alias("num_samples"))
