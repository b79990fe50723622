"""Every registered query against its SQL check at the smallest scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from tallyweave.catalog import entries
from tests.compare import compare, database

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", list(entries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name, entries()[name]) is None


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
