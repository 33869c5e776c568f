"""Every query with SQL gives exactly the SQL's rows; every other one gives rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from check_queries import compare, connect  # noqa: E402

from wildgrid.plans import catalogue  # noqa: E402

QUERIES, ORACLES = catalogue.load()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    verdict, rows = compare(spark, con, FOLDER, QUERIES[name], ORACLES[name])
    assert verdict == "ok"


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
