import os

import pytest

from siteloom import catalog

from . import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, oracle.FOLDER).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert oracle.rows(got) == oracle.rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 16
