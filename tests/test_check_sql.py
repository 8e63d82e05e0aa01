"""Every registered query against its check SQL on the smallest sample."""

import os

import pytest
from compare import connect, difference

from docketry.plans.catalog import QUERIES

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(spark, con, name, FOLDER) is None
