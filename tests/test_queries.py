"""Every registered general query against its SQL in DuckDB; rows only where there is none."""

import os

import pytest

from millrace.operators import joins
from millrace.plans import catalog
from tests.compare import same

SF = os.environ.get("MILLRACE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        same(df, catalog.ORACLES[name], SF)
    else:
        assert df.count() > 0


def test_pushdown(spark):
    """Filters and columns reach the scan."""
    plan = catalog.QUERIES["pricing_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan
    assert "l_orderkey" not in plan.split("ReadSchema")[1]


def test_not_in_is_null_aware(spark):
    """The join gives what SQL's own NOT IN gives, with and without nulls on either side."""
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for values in ([(2,)], [(2,), (None,)], []):
        right = spark.createDataFrame(values, "v int")
        ours = sorted(joins.not_in(rows, "k", right, "v").collect(), key=str)
        assert ours == sorted(spark.sql("SELECT k FROM {a} WHERE k NOT IN (SELECT v FROM {b})", a=rows, b=right).collect(), key=str)
