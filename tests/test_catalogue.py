import __spark_entry__ as entry
import pytest

from skeinwork.plans import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_against_sql(spark, small, against_sql, name):
    against_sql(queries.QUERIES[name](spark, small), oracle.SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_without_sql(spark, small, name):
    """Such a query gives the same rows again; other tests hold its operators against hand-made cases."""
    get = lambda: sorted(map(repr, queries.QUERIES[name](spark, small).collect()))
    rows = get()
    assert rows and rows == get()


def test_entry(spark):
    assert entry.entry(spark).columns == ["src", "dst", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
