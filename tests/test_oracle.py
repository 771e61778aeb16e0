"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as spec
from tablechange.plans.registry import ORACLES, QUERIES
from tools.check_oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(spec.oracle_sql()))
def test_query(spark, con, sf, name):
    assert compare(spark, con, name, sf) is None


def test_entry(spark):
    got = {(r["kind"], r["column"]): r["n"] for r in spec.entry(spark).collect()}
    assert got[("create", None)] == got[("drop", None)] == 150
    assert got[("change", "o_orderstatus")] == got[("change", "o_totalprice")] == 150
    assert got[("same", None)] == 900
