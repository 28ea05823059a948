"""Every core query with SQL against DuckDB, and every other one for rows and a stable schema."""

import pytest
from compare import connect, rows

from labloom.plans import registry

SQL, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, con, name):
    got = QUERIES[name](spark, small).toArrow().to_pandas()
    want = con.sql(SQL[name]).to_arrow_table().to_pandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_entry(spark, small):
    assert registry.flagship(spark, small).count() > 0
