import pytest
from comparing import rows_of

import __spark_entry__ as entry
import corpus_pipeline
from wavemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, data, name):
    got, expected = queries.QUERIES[name](spark, data).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k[: k.index("_") + 1] for k in names if k.startswith("op")} and "pipeline" in names
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_act_on_what_came_before(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, rows = docs.columns, docs
    counts = [rows.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, data).cache()
        assert rows.columns == columns
        counts.append(rows.count())
    assert counts[0] > counts[1] > counts[2] > counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, rows, data)
    assert last.columns == [*columns, "shard", "slot"] and last.count() == counts[-1]
    whole = corpus_pipeline.run(spark, data)
    key = lambda x: sorted((r.doc_id, r.shard) for r in x.select("doc_id", "shard").collect())
    assert key(whole) == key(last)


def test_stages_take_odd_rows(spark, data, odd_columns, empty):
    for rows in (odd_columns, empty):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, data)
            assert out.columns[: len(rows.columns)] == rows.columns
            out.count()


def test_what_stages_make_of_odd_rows(spark, data, docs):
    """Exactly these rows: nulls, blanks, repeats and ties, whatever other columns are called."""
    text = docs.filter("doc_id = 0").first().text
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, "en", "a"), (3, " \n", "en", None), (None, text, None, "b"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1L n_chars", "'own' Shard", "'own' __text", "'own' `row`")
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    expected = {
        "quality": [(None, text), (1, text), (1, text)],
        "near_duplicates": [(None, None), (None, text), (1, text), (2, None), (3, " \n")],
        "decontamination": [(r[0], r[1]) for r in rows],
    }
    none = spark.createDataFrame([], "doc_id long, quality int")
    from wavemark.llm import kneser_ney

    got = {name: stage(spark, frame, data) if name != "quality" else kneser_ney.keep_good(frame, none) for name, stage in corpus_pipeline.STAGES}
    for name, value in expected.items():
        assert key(got[name]) == sorted(value, key=str), name
    assert {r.text for r in got["mixture"].collect()} == {text}
    assert got["shards"].columns[-2:] == ["shard_1", "slot"] and sorted((r.shard_1, r.slot) for r in got["shards"].collect()) == [(0, 0), (1, 0), (2, 0), (4, 0), (5, 0), (6, 0)]
