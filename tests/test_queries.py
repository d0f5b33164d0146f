"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from tessera.plans.queries import ORACLES, QUERIES
from tests.oracle import SMALL, compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
