"""Queries with SQL give exactly its rows on the given tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

from check_queries import compare, connect  # noqa: E402

from wildgrid.llm import queries  # noqa: E402

QUERIES, ORACLES = queries.load()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    verdict, _ = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name])
    assert verdict == "ok"


def test_registered():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
