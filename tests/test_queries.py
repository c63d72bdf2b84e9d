"""Every core query runs, and equals its SQL where it has one."""

from __future__ import annotations

import pytest

from quantloom import queries
from tests.conftest import SF
from tests.oracle import connect, same

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        same(con, QUERIES[name](spark, SF), SQL[name])
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["entity", "sample", "estimate"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
