"""Every registered query against its SQL, exactly, on the smallest driver tables."""

import os

import pytest
from oracle import connect, differences

import __spark_entry__ as entry_point
from sitegauge.plans.catalogue import CATALOGUE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def sql():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_matches_sql(spark, sql, name):
    result = entry_point.queries()[name](spark, SF_DIR)
    assert differences(result, sql, entry_point.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql())))
def test_runs_without_sql(spark, name):
    """Results that other tests compare with direct computation; a search may rightly find nothing."""
    result = entry_point.queries()[name](spark, SF_DIR)
    assert result.columns and result.count() >= (1 if name in CATALOGUE else 0)


def test_entry(spark):
    rows = entry_point.entry(spark)
    assert rows.columns == ["host", "pages", "chunks", "chars"]
    assert rows.count() > 0
