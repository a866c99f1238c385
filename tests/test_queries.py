"""Every query of the library against its SQL counterpart."""

import pytest

from numera.plans import library
from tests.oracle import connect, rows_of, rows_of_sql

WHERE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(WHERE)


@pytest.mark.parametrize("name", sorted(library.queries()))
def test_query(spark, con, name):
    df = library.queries()[name](spark, WHERE)
    cols, rows = rows_of(df)
    sql = library.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want_cols, want = rows_of_sql(con, sql)
    assert cols == want_cols
    assert rows == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
