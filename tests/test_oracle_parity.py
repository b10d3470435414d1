"""Every registered query with an oracle agrees with DuckDB at sf0.001."""
import pytest

import __spark_entry__ as E
from pactum.plans.catalog import QUERIES
from oracle_check import compare, duck

from conftest import SMALL

SQL = E.oracle_sql()
NAMES = sorted(n for n in QUERIES if n in SQL)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, E.queries()[name], SQL.get(name), SMALL, con)
    assert res["ok"], res
