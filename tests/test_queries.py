"""Every query with SQL gives the SQL's rows; the others run."""

from pathlib import Path

import pytest

import __spark_entry__ as driver
import oracle

from assayer.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    assert oracle.by_spark(registry.QUERIES[name](spark, SF)) == oracle.by_sql(registry.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_twice_alike(spark, name):
    one, two = (oracle.by_spark(registry.QUERIES[name](spark, SF)) for _ in range(2))
    assert one == two and sum(one[1].values()) > 0


def test_entry(spark):
    assert driver.entry(spark).columns == ["doc_id", "near", "exact", "answer", "confidence", "threshold", "rule", "abstain"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
