"""Every registered query against its DuckDB oracle (sf0.001)."""

import pytest

from conftest import SF_SMALL
from parkops.plans.check import compare
from parkops.plans.oracle_sql import SQL
from parkops.plans.registry import QUERIES


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL), set(QUERIES) ^ set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_parity(spark, duck_small, name):
    r = compare(spark, duck_small, SF_SMALL, name, QUERIES[name], SQL.get(name))
    assert r["status"] == "ok", r
    assert "types" not in r, r


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 6027
    assert set(E.oracle_sql()) <= set(E.queries())
