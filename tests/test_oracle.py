"""Every SQL-expressible key against its DuckDB oracle on the driver's tables."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from oracle_check import compare, duck

KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, con, key):
    problems, _ = compare(spark, con, E.queries()[key], E.oracle_sql()[key], SMALL)
    assert not problems, problems


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "median" in df.columns
