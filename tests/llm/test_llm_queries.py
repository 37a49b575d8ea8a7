"""The queries that SQL can express, against DuckDB."""

import pytest
from oracle import compare, connect

from stratastats.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, folder, name):
    count, differences = compare(spark, connect(folder), folder, QUERIES[name], ORACLE[name])
    assert not differences and count > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op12_spelling_variants"}))
def test_query_covers_its_table(spark, folder, name):
    table = "pages" if name.startswith("op3_") else "documents"
    assert QUERIES[name](spark, folder).count() == spark.read.parquet(f"{folder}/{table}.parquet").count()
