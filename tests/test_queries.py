"""Every registered query of the core against its SQL."""

import oracle
import pytest

import __spark_entry__ as contract
from tallymark.plans import ORACLES, QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = oracle.connect(sf_dir)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, con, name):
    names, rows = oracle.spark_rows(contract.queries()[name](spark, sf_dir))
    sql_names, sql_rows = oracle.sql_rows(con, contract.oracle_sql()[name])
    assert names == sql_names
    assert rows == sql_rows
    assert rows


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:3] == ["model", "regime", "depth"]
    assert df.count() == 48
