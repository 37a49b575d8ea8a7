"""Every registered query against its SQL."""

import pytest
from oracle import compare, connect

from stratastats.workload import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, folder, name):
    rows, differences = compare(spark, con, folder, QUERIES[name], ORACLE[name])
    assert not differences
    assert rows > 0


def test_entry(spark):
    import __spark_entry__ as e

    first = e.entry(spark)
    assert first.count() == 20
    assert first.schema == e.entry(spark).schema
    assert set(e.oracle_sql()) <= set(e.queries())
