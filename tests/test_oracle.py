"""Every query with SQL against DuckDB on the smallest tables; the others run and give their rows."""

import pytest

from conftest import oracle, rows_of
from tariffloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf, name):
    found, wanted = catalogue.QUERIES[name](spark, sf).toPandas(), oracle(catalogue.SQL[name], sf)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
