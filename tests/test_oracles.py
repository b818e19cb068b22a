"""Every query with SQL gives the SQL's rows; the others give rows."""

from __future__ import annotations

import pytest
from compare import compare, connect

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", ["bkt_em_fit", "bootstrap_ci", "dropout_lr", "occupancy_lr", "heldout_serving"])
def test_iterative_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["bkt_trajectory", "attendance_snapshot", "event_timeline"])
def test_split_keys_give_the_same_rows(spark, con, name):
    """With a low row limit most keys go through the segment paths."""
    spark.conf.set("spark.edupulse.maxRowsPerGroup", "25")
    try:
        assert compare(spark, con, SF, name, QUERIES[name], ORACLES[name]) is None
    finally:
        spark.conf.unset("spark.edupulse.maxRowsPerGroup")
