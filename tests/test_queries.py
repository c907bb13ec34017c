"""Every registered query against its SQL on the same tables."""

import pytest
from harness import compare, connect

import runlens.plans.queries  # noqa: F401
from runlens.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, sf_dir, key):
    assert compare(spark, con, key, QUERIES[key], sf_dir) == ""


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert len(contract.entry(spark).columns) == 74
    assert set(contract.oracle_sql()) <= set(contract.queries())
