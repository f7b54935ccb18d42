"""Every registered query against its SQL, over the whole smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from checks.compare import differences
from checks.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.keys() <= entry_points.queries().keys()
    assert entry_points.oracle_sql().keys() <= entry_points.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    found = differences(spark, FOLDER, name)
    assert found["columns"][0] == found["columns"][1]
    assert (found["only_spark"], found["only_sql"]) == ([], [])
    assert found["rows"][0] > 0


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.count() > 0 and "aphiaid" in frame.columns
