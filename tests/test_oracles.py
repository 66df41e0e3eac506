"""Every registered query with SQL must equal DuckDB on the same tables."""

import os

import pytest

import __spark_entry__ as contract
import oracle

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    assert oracle.compare(df, con, ORACLES[name]) == ""


def test_entry(spark):
    assert contract.entry(spark).columns == ["subject_id", "item_id", "cnt"]
