import os

import pytest
from pyspark.sql import functions as F

from wavemark.plans import as_queries
from wavemark.sources import sink, store

PRINTS = "track_name string, seq int, hash bigint, anchor_time float"


def rows(spark, start, n):
    return spark.createDataFrame([(f"t{i % 5 + start}", i, i * 31, 0.1 * i) for i in range(n)], PRINTS).repartition(3)


def names(path):
    return sorted(x for x in os.listdir(path) if x.startswith((sink.SEGMENT, sink.STAGED)))


def test_writing_fingerprints_gives_an_index(spark, tmp_path):
    sink.register(spark)
    path = str(tmp_path / "db")
    rows(spark, 0, 100).write.format("wave_index").mode("append").save(path)
    assert len(names(path)) == 1
    index = sink.opened(spark, path)
    assert (index.track_count(), index.hash_count()) == (5, 100) and names(path) == []
    rows(spark, 3, 50).select("anchor_time", "hash", "track_name").write.format("wave_index").mode("append").save(path)
    assert store.load(spark, path).hash_count() == 100
    index = sink.opened(spark, path)
    assert (index.track_count(), index.hash_count()) == (8, 150)
    assert sorted(r.track_id for r in index.tracks.collect()) == list(range(8))
    (best,) = store.query_store(spark, path, as_queries(rows(spark, 0, 100).filter("track_name = 't2'"))).collect()
    assert (best.track_id, best["score"]) == ("t2", 20)
    rows(spark, 0, 10).write.format("wave_index").mode("overwrite").save(path)
    assert sink.opened(spark, path).hash_count() == 10


def test_a_failed_task_leaves_the_old_index(spark, tmp_path):
    sink.register(spark)
    path = str(tmp_path / "db")
    rows(spark, 0, 30).write.format("wave_index").mode("append").save(path)
    sink.absorb(spark, path)
    bad = rows(spark, 5, 30).withColumn("hash", F.when(F.col("seq") == 29, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("hash")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("wave_index").mode("append").save(path)
    assert names(path) == [] and sink.opened(spark, path).hash_count() == 30
    with pytest.raises(Exception, match="anchor_time"):
        rows(spark, 0, 5).drop("anchor_time").write.format("wave_index").mode("append").save(path)


def test_a_segment_counts_once(spark, tmp_path, monkeypatch):
    sink.register(spark)
    path = str(tmp_path / "db")
    rows(spark, 0, 20).write.format("wave_index").mode("append").save(path)
    with monkeypatch.context() as m:
        m.setattr(store.Store, "drop", lambda self, name: None)  # dies before it deletes the segment
        assert sink.absorb(spark, path) == 1
    assert len(names(path)) == 1 and sink.segments(spark, path) == []
    assert sink.absorb(spark, path) == 0 and names(path) == []
    assert store.load(spark, path).hash_count() == 20
    with pytest.raises(store.SegmentTaken):
        taken = store.Store(spark, path).current()["segments"][0]
        store.append(spark, path, rows(spark, 0, 20), segment=taken)
    assert store.load(spark, path).hash_count() == 20


def test_messages_of_tasks_decide_what_is_kept(tmp_path):
    import pyarrow as pa

    out = sink.IndexWriter(f"file://{tmp_path}", False)
    batch = pa.RecordBatch.from_pydict({"hash": [1, 2], "track_name": ["a", "b"], "anchor_time": [0.5, 1.0]})
    first, again, none = out.write(iter([batch])), out.write(iter([batch])), out.write(iter([]))
    assert none.file is None and len(os.listdir(out.staged)) == 2
    out.commit([first, none, None])
    (segment,) = names(tmp_path)
    assert os.listdir(tmp_path / segment) == [first.file] and first.file != again.file
    out = sink.IndexWriter(str(tmp_path), False)
    out.write(iter([batch]))
    out.abort([None])
    assert names(tmp_path) == [segment]
