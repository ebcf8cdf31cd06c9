"""Every registered query against its SQL."""

import oracle
import pytest

from corpusmill.suite import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    assert name in ORACLES
    assert oracle.compare(con, df, ORACLES[name]) == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= entry.oracle_sql().keys()
