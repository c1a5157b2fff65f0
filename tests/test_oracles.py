"""Every registered query with a DuckDB statement gives the same rows as DuckDB; the others run."""

import os

import pytest

from labelkite import catalog
from tests.oracle import compare, connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name in catalog.ORACLES:
        assert compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLES[name]) == ""
    else:
        assert catalog.QUERIES[name](spark, SF).count() >= 0
