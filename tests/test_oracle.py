"""Every query with SQL gives DuckDB's rows; the others give rows with named columns."""

from __future__ import annotations

import oracle
import pytest

from corvane import catalog

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    df, sql = catalog.queries()[name](spark, sf_dir), catalog.oracle_sql().get(name)
    if sql:
        assert not oracle.difference(df, con, sql)
    else:
        assert df.count() > 0
        assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
