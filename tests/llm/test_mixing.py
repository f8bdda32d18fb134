from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from wavemark.llm.common import running_sums
from wavemark.llm.mixing import mix, resampled, source_targets


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), dict.fromkeys(names, 0.0), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        for s in free:
            target[s] = rest * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = most * sizes[s]
            capped.add(s)


def check(rows, near):
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.row.source] += r["size"]
        taken[r.row.source] += r.taken
        targets[r.row.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    expected = brute_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(expected[s])
        assert abs(taken[s] - targets[s]) <= near(s)
    for r in rows:
        assert r.source_size == sizes[r.row.source]


def test_targets_and_sample(spark):
    rows = [(i, "w " * (5 + i * 37 % 900), f"s{i % 7 if i % 3 else 0}") for i in range(700)] + [(9000 + i, "x " * 50, None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, carry=F.struct("source")).collect()
    check(got, lambda s: 300)  # about one document of 30000 words
    again = mix(docs.repartition(9), carry=F.struct("source")).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_longer_documents_have_better_odds(spark):
    rows = [(i, "w " * (50 if i % 2 else 1500), "only") for i in range(3000)] + [(5000 + i, "w " * 700, "z") for i in range(3000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=F.struct("source")).collect()
    only = [r for r in got if r.row.source == "only"]
    long, short = ([r.copies for r in only if (r["size"] > 100) is k] for k in (True, False))
    assert sum(long) / len(long) > 1.5 * sum(short) / len(short)
    # Copies are the whole part of the expectation, or one more.
    assert len(set(long)) <= 2 or max(long) - min(long) <= 2


def test_corpus_and_edges(docs, corpus, empty, odd_columns, spark):
    rows = mix(docs, carry=F.struct("source")).collect()
    assert len(rows) == len(corpus)
    largest = defaultdict(int)
    for r in rows:
        largest[r.row.source] = max(largest[r.row.source], r["size"])
    check(rows, lambda s: largest[s])
    assert mix(empty).count() == 0 == resampled(empty).count()
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mix(blank).collect()] == [(0, 0.0)] * 2
    out = resampled(odd_columns)
    assert out.columns == odd_columns.columns and out.count() == sum(r.copies for r in rows)


def test_one_source_is_taken_whole(spark):
    rows = [(i, "w " * (10 + i), "a") for i in range(50)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), merit=lambda s: s * 0 + 1).collect()
    assert {r.copies for r in got} == {1}


@pytest.fixture
def many_ranges(spark):
    """Small tables keep their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_over_ranges(spark, many_ranges):
    rows = [(i * 7919 % 5000, i % 13) for i in range(5000)]
    frame = spark.createDataFrame(rows, "k int, v int").withColumn("one", F.lit(1))
    got = running_sums(frame, ["k"], {"rank": "one", "upto": "v"}, "t").orderBy("k").collect()
    upto = 0
    for i, r in enumerate(got):
        assert (r.k, r["rank"], r.upto, r.all_rank, r.all_upto) == (i, i, upto, 5000, sum(v for _, v in rows))
        upto += r.v
    assert running_sums(frame.limit(0), ["k"], {"rank": "one"}, "t").count() == 0


def test_as_many_sources_as_documents(spark, many_ranges):
    sizes = {(f"s{i:05}" if i else None): 1 + i * 7919 % 997 for i in range(4000)} | {"none": 0}
    classes = spark.createDataFrame([*sizes.items()], "source string, class_size long")
    table = source_targets(classes, (5, 2, 1), 3)
    got = {r.source: (r.source_size, r.target) for r in table.collect()}
    expected = brute_targets({s: n for s, n in sizes.items()})
    assert {s: n for s, (n, _) in got.items()} == sizes
    assert all(got[s][1] == pytest.approx(expected[s]) for s in sizes)
