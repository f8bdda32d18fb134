import threading

import pytest
from pyspark.sql import functions as F

from wavemark.config import IndexConfig
from wavemark.errors import IndexStoreError
from wavemark.operators.index import FingerprintIndex
from wavemark.plans import as_queries
from wavemark.sources import store
from wavemark.sources.store import Layout, Store

PRINTS = "track_name string, seq int, hash bigint, anchor_time float"
SMALL = Layout(shard_rows=22, max_shards=1024, level_rows=50)


def prints(spark, tracks):
    return spark.createDataFrame([(t, i, h, float(a)) for t, rows in tracks.items() for i, (h, a) in enumerate(rows)], PRINTS)


def tracks(spark, n, each=20):
    rows = spark.range(n * each).select(F.concat(F.lit("t"), F.floor(F.col("id") / each)).alias("track_name"), (F.col("id") % each).cast("int").alias("seq"), (F.col("id") * 7919).alias("hash"), (F.col("id") % each * 0.05).cast("float").alias("anchor_time"))
    return rows


def scans(plan):
    """Executed file scans of a plan, with those of stages and subplans."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scans(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return scans(plan.plan())
    found = [plan] if name == "FileSourceScanExec" else []
    children = plan.children()
    return found + [x for i in range(children.size()) for x in scans(children.apply(i))]


def files_read(df):
    """Files of postings that the executed plan opened."""
    plan = df._jdf.queryExecution().executedPlan()
    return sum(x.metrics().apply("numFiles").value() for x in scans(plan) if "shard" in x.relation().partitionSchema().simpleString())


def test_a_small_query_opens_few_of_a_thousand_files(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    rows = tracks(spark, 1100)
    store.save(FingerprintIndex.build(rows), path, SMALL)
    held = Store(spark, path)
    (part,) = held.current()["parts"]
    assert part["shards"] == 1024 and part["postings"] == 22_000
    total = sum(x.endswith(".parquet") for x in (f for d in held._fs.globStatus(held._path(f"{path}/{part['name']}/postings/shard=*")) for f in (y.getPath().getName() for y in held._fs.listStatus(d.getPath()))))
    asked = as_queries(rows.filter("track_name = 't7'"))
    found = store.query_store(spark, path, asked)
    (row,) = found.collect()
    assert (row.query_id, row.track_id, row.score) == ("t7", "t7", 20)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    read = files_read(found)
    assert total >= 1000 and 0 < read <= 0.05 * total


def test_pruned_query_equals_that_of_the_whole(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/db"
    rows = tracks(spark, 40)
    store.save(FingerprintIndex.build(rows.filter("track_name < 't2'"), IndexConfig(0.01)), path, SMALL)
    store.append(spark, path, rows.filter("track_name >= 't2'"), layout=Layout(shard_rows=7))
    assert len({part["shards"] for part in Store(spark, path).current()["parts"]}) == 2
    asked = as_queries(rows).union(spark.createDataFrame([("none", -5, 0.0)], "query_id string, hash bigint, anchor_time float"))
    key = lambda df: sorted(map(tuple, df.collect()))
    expected = key(store.load(spark, path).query_batch(asked, 3))
    assert key(store.query_store(spark, path, asked, 3)) == expected and len(expected) == 40
    monkeypatch.setattr(store, "PRUNING", 10)
    assert key(store.query_store(spark, path, asked, 3)) == expected
    assert store.query_store(spark, path, asked.limit(0)).count() == 0


def test_a_very_common_fingerprint_fills_several_files(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    rows = tracks(spark, 50).withColumn("hash", F.when(F.col("seq") < 10, F.lit(5)).otherwise(F.col("hash")))
    store.save(FingerprintIndex.build(rows), path, Layout(shard_rows=100))
    counts = store.load(spark, path).postings.filter("hash = 5").groupBy(F.input_file_name()).count().collect()
    assert len(counts) >= 4 and sum(r["count"] for r in counts) == 500


def test_levels_bound_the_parts(spark, tmp_path):
    path, n, layout = f"file://{tmp_path}/db", 6, Layout(level_rows=20, shard_rows=1000, fanout=2)
    for i in range(n):
        store.append(spark, path, prints(spark, {f"n{i}": [(i * 10 + k, 0.1 * k) for k in range(10)]}), layout=layout)
    held = Store(spark, path)
    levels = [layout.level(part["postings"]) for part in held.current()["parts"]]
    assert len(set(levels)) == len(levels) <= 4
    index = store.load(spark, path)
    assert (index.track_count(), index.hash_count()) == (n, 10 * n)
    assert sorted(r.track_id for r in index.tracks.collect()) == list(range(n))
    on_disk = {x for x in held.children() if x.startswith("part-")}
    assert {part["name"] for part in held.current()["parts"]} <= on_disk and len(on_disk) <= len(levels) + 8
    assert store.compact(spark, path, Layout(level_rows=10**6, fanout=2)) == 1 and len(held.current()["parts"]) == 1
    assert store.load(spark, path).hash_count() == 10 * n


def test_a_hundred_appends_leave_a_dozen_parts():
    layout, parts, written = Layout(), [], 0
    for _ in range(100):
        parts.append(300_000)
        while full := [x for x in {layout.level(p) for p in parts} if sum(layout.level(p) == x for p in parts) >= layout.fanout]:
            merged = [p for p in parts if layout.level(p) == min(full)]
            parts = [p for p in parts if layout.level(p) != min(full)] + [sum(merged)]
            written += sum(merged)
    assert sum(parts) == 100 * 300_000 and len(parts) <= 12 and written <= 4 * sum(parts)


def test_levels_follow_sizes():
    layout = Layout(level_rows=10, fanout=4)
    assert [layout.level(n) for n in (0, 9, 10, 39, 40, 160)] == [0, 0, 1, 1, 2, 3]
    assert [Layout(shard_rows=10, max_shards=64).shards(n) for n in (0, 10, 11, 40, 41, 10**9)] == [1, 1, 2, 4, 8, 64]


def test_writers_at_the_same_time_both_land(spark, tmp_path):
    path, errors = f"file://{tmp_path}/db", []
    store.append(spark, path, prints(spark, {"both": [(1, 0.0)]}))

    def write(k):
        try:
            for i in range(2):
                store.append(spark, path, prints(spark, {f"w{k}-{i}": [(k, 0.0), (i, 1.0)], "both": [(k, 2.0)]}))
        except Exception as e:  # shown by the assertion
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    index = store.load(spark, path)
    ids = {r.track_name: r.track_id for r in index.tracks.collect()}
    assert sorted(ids.values()) == list(range(7)) and len(ids) == 7
    assert index.hash_count() == 1 + 3 * 2 * 3
    assert index.postings.filter(F.col("track_id") == ids["both"]).count() == 7


def test_a_writer_that_comes_second_counts_again(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/db"
    store.append(spark, path, prints(spark, {"a": [(1, 0.0)]}))
    plain, tried = Store.commit, []

    def late(self, number, meta):
        if not tried:
            tried.append(number)
            monkeypatch.setattr(Store, "commit", plain)
            store.append(spark, path, prints(spark, {"first": [(2, 0.0)], "shared": [(3, 0.0)]}))
        return plain(self, number, meta)

    monkeypatch.setattr(Store, "commit", late)
    store.append(spark, path, prints(spark, {"second": [(4, 0.0)], "shared": [(5, 0.0)]}))
    index = store.load(spark, path)
    named = index.postings.join(index.tracks, "track_id").collect()
    assert sorted((r.track_name, r.hash) for r in named) == [("a", 1), ("first", 2), ("second", 4), ("shared", 3), ("shared", 5)]
    assert sorted(r.track_id for r in index.tracks.collect()) == [0, 1, 2, 3]


def test_a_merge_whose_parts_are_gone_is_dropped(spark, tmp_path, monkeypatch):
    path, one = f"file://{tmp_path}/db", Layout(fanout=2)
    for i in range(2):
        store.append(spark, path, prints(spark, {f"a{i}": [(i, 0.0)]}), layout=one, merge=False)
    plain, done = Store.write, []

    def slow(self, *args):
        out = plain(self, *args)
        if not done:
            done.append(1)
            store.save(store.load(spark, path), path)
        return out

    monkeypatch.setattr(Store, "write", slow)
    assert store.compact(spark, path, one) == 0
    assert store.load(spark, path).hash_count() == 2 and len(Store(spark, path).current()["parts"]) == 1


def test_readers_keep_their_state_over_one_more_append(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    for i in range(3):
        store.append(spark, path, prints(spark, {f"a{i}": [(i, 0.0)]}))
    reader = store.load(spark, path)
    store.append(spark, path, prints(spark, {"a3": [(3, 0.0)]}))  # fills the level, which is merged
    assert len(Store(spark, path).current()["parts"]) == 1
    assert reader.hash_count() == 3 and store.load(spark, path).hash_count() == 4


def test_what_writers_left_behind_goes_in_time(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/db"
    store.append(spark, path, prints(spark, {"a": [(1, 0.0)]}))
    (tmp_path / "db" / "part-lost").mkdir()
    store.append(spark, path, prints(spark, {"b": [(1, 0.0)]}))
    assert "part-lost" in Store(spark, path).children()
    monkeypatch.setattr(store, "GRACE", -60)
    Store(spark, path).clear()
    assert "part-lost" not in Store(spark, path).children() and store.load(spark, path).hash_count() == 2


def test_tracks_without_hashes_and_the_bin_size_survive(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    assert store.open_or_create(spark, path, IndexConfig(0.02)).track_count() == 0
    store.append(spark, path, prints(spark, {}), spark.createDataFrame([("silent",)], "track_name string"))
    index = store.open_or_create(spark, path)
    assert (index.track_count(), index.hash_count(), index.config.offset_bin_size) == (1, 0, 0.02)


def test_pointers_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "CURRENT-000000000001").write_text('{"parts": ["snapshot-1"]}')
    with pytest.raises(IndexStoreError):
        store.load(spark, f"file://{tmp_path}")
    (tmp_path / "CURRENT-000000000002").write_text("no json")
    with pytest.raises(IndexStoreError):
        store.load(spark, f"file://{tmp_path}")
