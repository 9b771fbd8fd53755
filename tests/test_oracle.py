"""Every registered query that SQL can express, against DuckDB."""

import pytest

import __spark_entry__ as entry
from tests import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    _, _, bad = oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert not bad


def test_entry(spark):
    assert entry.entry(spark).count() == 11
