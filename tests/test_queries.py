import pytest
from comparing import rows_of

from wavemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, data, name):
    got, expected = catalogue.QUERIES[name](spark, data).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["offset_histogram", "offset_histogram_common"])
def test_votes_leave_their_task_once(spark, data, name):
    """All votes are quadratic in the tracks: after they are counted nothing joins or shuffles them."""
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert "Exchange" not in plan.split("CartesianProduct")[0]
