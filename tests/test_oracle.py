"""Every registered query with oracle SQL equals DuckDB on the smallest fixture."""

import pytest

from tools.oracle_check import compare

import __spark_entry__ as E

ORACLE_NAMES = sorted(E.oracle_sql())


def test_registry_shape():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert "feature_table" in q and "feature_table" in sql
    assert len(q) >= 70


@pytest.mark.parametrize("name", ORACLE_NAMES)
def test_matches_oracle(spark, sf_dir, name):
    res = compare(spark, sf_dir, [name], verbose=False)[name]
    assert res[0] == "OK", res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "msno" and "is_churn" in df.columns
    assert df.count() > 0
