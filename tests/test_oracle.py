"""Every registered query with a SQL form equals it; the others run and return rows."""

import pytest

from oracle import compare, connect
from tidemill import registry

registry.load_all()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, folder, duck, name):
    found = registry.QUERIES[name](spark, folder).toPandas()
    assert compare(found, duck.execute(registry.ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, folder, name):
    assert len(registry.QUERIES[name](spark, folder).toPandas()) > 0
