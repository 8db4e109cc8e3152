"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
import workload
from workload.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = workload.QUERIES, workload.ORACLES


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    state = compare(spark, duck, QUERIES[name], ORACLES.get(name), FOLDER)
    assert state == "ok" or state.startswith("rows only"), state


def test_entry_has_rows_and_schema(spark):
    frame = entry.entry(spark)
    assert len(frame.columns) == 26
    assert frame.count() > 0
