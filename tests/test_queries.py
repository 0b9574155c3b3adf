import pytest

from kinfold import queries as Q

from .compare import rows, sql


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, sf, name):
    assert rows(Q.QUERIES[name](spark, sf).toPandas()) == rows(sql(Q.SQL[name], sf))


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    counts = {r["action"]: r["count"] for r in e.entry(spark).groupBy("action").count().collect()}
    assert counts == {"rescued": 86, "vetoed": 16, "no_body": 25, "insufficient": 44}
    assert set(e.oracle_sql()) <= set(e.queries())
