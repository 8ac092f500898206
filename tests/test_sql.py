"""Every core query that has SQL gives the rows of the SQL."""

import oracle
import pytest

from pairloom.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    assert oracle.compare(registry.queries()[name](spark, FOLDER), registry.oracle_sql()[name], tables) is None


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0
