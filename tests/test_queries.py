"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import compare
from tiergraph.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return compare.database(SF_DIR)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    outcome = compare.compare(spark, con, SF_DIR, name, REGISTRY[name])
    assert outcome.startswith("ok" if REGISTRY[name].sql else "rows only"), outcome


def test_entry_and_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
