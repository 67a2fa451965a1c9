"""Physical plans: what is read, what is shuffled, and that windows have keys."""

from __future__ import annotations

import re

import pytest

from fieldloom.operators import stats
from fieldloom.operators.windows import prefix_sum, shifted
from fieldloom.plans import catalog
from fieldloom.sources.fixtures import fixture

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_a_query_needs(spark):
    plan = plan_of(stats.value_range(fixture(spark, SMALL, "orders").cells))
    assert re.findall(r"ReadSchema: struct<(.*?)>", plan) == ["o_totalprice:double"]
    plan = plan_of(catalog.QUERIES["sample_szx"](spark, SMALL))
    assert all("ReadSchema: struct<event_id:bigint,value:double>" in x for x in re.findall(r"ReadSchema.*", plan))


@pytest.mark.parametrize(("name", "exchanges"), [("calc_stats", 1), ("verify_stats", 1), ("block_profile", 1), ("prefilter_range", 3)])
def test_shuffles(spark, name, exchanges):
    spark.catalog.clearCache()  # what a search keeps would show in the plan
    assert len(re.findall(r"\bExchange\b", plan_of(catalog.QUERIES[name](spark, SMALL)))) <= exchanges


def test_windows_have_partitions(spark):
    cells = spark.range(10).selectExpr("id as idx", "cast(id as float) as v")
    assert "Window [lead" in plan_of(shifted(cells, {"b": ("v", 1)}))
    for spec in re.findall(r"windowspecdefinition\((.*?)\)", plan_of(shifted(cells, {"b": ("v", 1), "a": ("v", -2)}))):
        assert spec.startswith("home#")
    assert "chunk#" in plan_of(prefix_sum(cells.selectExpr("idx", "idx as step"), "step", "total"))


def test_chunked_windows_match_whole_ones(spark):
    cells = spark.range(1000).selectExpr("id as idx", "cast((id * 37) % 101 as float) as v", "(id * 37) % 101 as step").repartition(5)
    values = [(i * 37) % 101 for i in range(1000)]
    got = sorted(tuple(r) for r in shifted(cells, {"b": ("v", 2), "a": ("v", -3)}, chunk=16).select("idx", "b", "a").collect())
    assert got == [(i, values[i + 2] if i + 2 < 1000 else None, values[i - 3] if i >= 3 else None) for i in range(1000)]
    sums = sorted(tuple(r) for r in prefix_sum(cells, "step", "total", chunk=16).select("idx", "total").collect())
    assert [s for _, s in sums] == [sum(values[: i + 1]) for i in range(1000)]
