"""Every query outside the text subpackage runs; those with SQL agree with it, whole."""

from __future__ import annotations

import oracle
import pytest
from conftest import SMALL

from textloom import catalog


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    if name in catalog.ORACLES:
        assert not oracle.differs(df, duck, catalog.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert catalog.FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
