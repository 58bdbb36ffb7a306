"""Every registered query against its statement."""

import pytest

import __spark_entry__ as contract
from oracles import ORACLES
from oracles.compare import compare

# the names are known without a session
from inkprint.plans.queries import QUERIES


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    difference = compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name])
    assert difference is None, difference


def test_entry(spark):
    row = contract.entry(spark).first()
    assert row["total_units"] > 0 and row["files_scanned"] > 0
