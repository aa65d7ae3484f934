"""Every registered query against its SQL counterpart, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from compare import differences, duck
from oracles import ORACLES
from queries import FOUND

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(FOUND) == set(ORACLES)
    assert set(FOUND) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(FOUND))
def test_same_result(spark, con, name):
    assert differences(entry_points.queries()[name](spark, SF_DIR), entry_points.oracle_sql()[name], con) == []


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0
