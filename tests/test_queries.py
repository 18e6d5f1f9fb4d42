"""Every query beside its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import verify

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return verify.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    said = verify.compare(spark, con, SF, name)
    assert said.startswith(("ok", "rows only")), said


def test_flagship(spark):
    assert entry.entry(spark).columns == ["id", "root_id", "depth"]


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
