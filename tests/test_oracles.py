"""Every query with SQL gives the same rows as another engine."""

from __future__ import annotations

import pytest
from helpers import SF, same

from siftwood import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_as_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck.execute(oracles.ORACLES[name]) if hasattr(duck, "execute") else duck.sql(oracles.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_runs_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
    for extra in ("entry", "queries", "oracle_sql"):
        assert callable(getattr(e, extra))
