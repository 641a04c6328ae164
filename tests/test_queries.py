"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def results(spark):
    """All queries with a twin, a few at a time; an error is kept as the result."""

    def run(name):
        try:
            return entry.queries()[name](spark, SF).toPandas()
        except Exception as e:  # noqa: BLE001
            return e

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(SQL, pool.map(run, SQL)))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(results, con, name):
    got = results[name]
    if isinstance(got, Exception):
        raise got
    assert difference(got, con.execute(SQL[name]).df()) is None
