"""Every registered query with SQL gives the same rows on DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_flagship(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.MORE])
def test_query(spark, con, name):
    state, _, rows, note = check.compare(spark, con, FOLDER, name, entry.queries(), entry.oracle_sql())
    assert state in ("ok", "rows-only"), note
