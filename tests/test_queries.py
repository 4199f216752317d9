"""Every catalog query runs; those with SQL agree with DuckDB on every value."""

import compare
import pytest

from docloom.plans import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connection(SF)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CATALOG.items() if sql))
def test_same_as_sql(spark, duck, name):
    query, sql = CATALOG[name]
    assert compare.differences(query(spark, SF), duck, sql) == []


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CATALOG.items() if not sql))
def test_runs(spark, name):
    assert CATALOG[name][0](spark, SF).count() > 0


def test_names_follow_the_contract():
    assert not [n for n in CATALOG if "pipeline" in n or n.startswith("op")]
