"""Every query of the library against its oracle on the smallest tables."""

import pytest

from quern.plans import registry
from tests.oracle import connect, same

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, con, name):
    df = registry.queries()[name](spark, small)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        same(df, con, sql)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
