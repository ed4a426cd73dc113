"""Every registered query with SQL against that SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from paceline import catalog
from compare import connect, difference

#: minutes each; ``tests/compare.py`` runs them
SLOW = {"evaluate_grid", "global_summary", "slice_grid", "density_grid"}
SQL = {n: q for n, q in entry.oracle_sql().items() if n in catalog.QUERIES}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in SQL if n not in SLOW])
def test_query_matches_sql(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert difference(got, con.execute(SQL[name]).df()) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
