"""Every SQL-expressible registered query equals its DuckDB oracle (sf0.001)."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def _names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck_con():
    from oracle_check import duck
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck_con, name):
    import __spark_entry__ as E
    from oracle_check import compare
    ok, msg = compare(E.queries()[name](spark, SF), duck_con, E.oracle_sql()[name])
    assert ok, msg


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert len(df.columns) > 0 and df.count() >= 0
