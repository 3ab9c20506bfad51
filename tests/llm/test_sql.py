"""Queries that SQL can express against their SQL, whole tables of the smallest size."""

from __future__ import annotations

import oracle
import pytest
from conftest import SMALL

from textloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    assert not oracle.differs(QUERIES[name](spark, SMALL), oracle.connect(SMALL), ORACLES[name])
