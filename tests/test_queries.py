"""Every registered query of the drawing engine against its SQL, or for rows where it has none."""

import pytest

from plumbline import catalogue

from . import oracle

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    if name in SQL:
        oracle.compare(spark, con, folder, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.oracle_sql()) <= set(entry.queries())
