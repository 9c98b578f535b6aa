"""Every query with SQL gives the same rows in Spark and DuckDB."""

from __future__ import annotations

import pytest

from ledgerloom.plans.registry import ORACLES, QUERIES
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    check(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2300
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
