"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
import check_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note = check_queries.compare(spark, con, name, SF)
    assert ok, note
