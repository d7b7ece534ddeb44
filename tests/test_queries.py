"""Every query of the engine against its SQL; the two forms are independent implementations."""

import pytest

import __spark_entry__ as entry
from tessera.plans import ops, ssb, tpch
from tests.oracle import compare, tables

SF = "/root/testdata/sf0.01"
OWN = {**tpch.ORACLE, **ops.ORACLE, **ssb.ORACLE}
ONE_ROW_OR_NONE = {"op_agg_sum_empty"}


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(OWN))
def test_matches_sql(spark, con, name):
    n = compare(entry.queries()[name](spark, SF), con, OWN[name])
    assert n > 0


@pytest.mark.parametrize("name", sorted((ops.QUERIES.keys() | tpch.QUERIES.keys() | ssb.QUERIES.keys()) - OWN.keys()))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
