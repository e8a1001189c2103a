"""Every registered query against its DuckDB oracle on the smallest scale."""

import os

import pytest

from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def _names():
    from visitstat.plans import oracle_sql
    return sorted(oracle_sql.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    assert compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)


def test_every_report_has_an_oracle():
    import __spark_entry__ as E
    from visitstat.plans import catalog
    assert set(catalog.queries()) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["date", "count", "avg", "median", "min", "max", "sko", "koef_var"]
    assert df.count() > 0
