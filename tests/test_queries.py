"""Every registered query against its SQL twin on the smallest tables, and plan assertions."""

import pytest

from listingspark import registry
from tests.compare import differences

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
FREE = [n for n in registry.queries() if n not in SQL]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert differences(spark, registry.queries()[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(FREE))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


PYTHON_FREE = [n for n in registry.queries() if n[0] in "abcdefgi" and n[1].isdigit()]


@pytest.mark.parametrize("name", PYTHON_FREE)
def test_plans_hold_no_python_and_no_cartesian_product(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups"))


def test_flagship_returns_rows(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["listing_id", "address_key", "score", "station", "station_m"]
    assert 0 < out.count() <= 50
