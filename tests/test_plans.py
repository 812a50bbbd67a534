"""Plan shape: pruning, push-down, single shuffle and broadcast choices."""

from pyspark.sql import functions as F

from tabsight.operators import grouped as G
from tabsight.operators import predicates as PR
from tabsight.operators import stats as S
from tabsight.plans.tables import load

from conftest import SF_SMALL


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_breakdown_is_one_scan_one_shuffle(spark):
    orders = load(spark, SF_SMALL, "orders")
    p = plan(G.breakdown(orders, "o_orderpriority", ["o_totalprice"]))
    assert p.count("FileScan") == 1
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" not in p
    assert "ReadSchema: struct<o_totalprice:double,o_orderpriority:string>" in p


def test_filters_reach_the_scan(spark):
    orders = load(spark, SF_SMALL, "orders")
    out = PR.apply_filters(orders, [{"column": "o_orderstatus", "type": "select", "value": "F"},
                                    {"column": "o_totalprice", "type": "range", "value": [1, 2]}])
    p = plan(out)
    assert "PushedFilters" in p and "EqualTo(o_orderstatus,F)" in p
    assert "GreaterThanOrEqual(o_totalprice,1" in p


def test_missing_counts_single_pass(spark):
    li = load(spark, SF_SMALL, "lineitem")
    p = plan(S.missing_counts(li))
    assert p.count("FileScan") == 1 and "Expand" not in p


def test_top_categories_semi_join_is_broadcast(spark):
    li = load(spark, SF_SMALL, "lineitem")
    top = G.top_categories(li, "l_suppkey", 10).select("l_suppkey")
    kept = li.join(F.broadcast(top), "l_suppkey", "left_semi")
    kept.collect()
    assert "BroadcastHashJoin" in plan(kept) or "BroadcastHashJoin" in \
        kept._jdf.queryExecution().executedPlan().toString()


def test_no_unbounded_global_window_or_cartesian(spark):
    """A window without partitionBy may only order small tables: the running
    total's per-partition sums, or a resampled series (one row per period)."""
    import re

    from tabsight.plans.registry import all_queries
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    global_window = re.compile(r"windowspecdefinition\(([^,()]+) (ASC|DESC) ")
    series_queries = {"window_position"}
    for q in all_queries():
        p = plan(q.build(spark, SF_SMALL))
        assert "CartesianProduct" not in p, q.name
        for line in p.splitlines():
            if "Window [" in line and global_window.search(line):
                assert "_ts_ptotal" in line or q.name in series_queries, (q.name, line.strip()[:160])
