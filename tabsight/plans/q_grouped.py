"""Queries for grouped aggregations, Pareto and ordered picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouped as G
from ..operators import windows as W
from .common import rounded
from .registry import Query
from .tables import load


def _breakdown(spark, d):
    orders = load(spark, d, "orders")
    return rounded(G.breakdown(orders, "o_orderpriority", ["o_totalprice"], top=10))


BREAKDOWN_SQL = """
with g as (
  select o_orderpriority, count(*) as n, avg(o_totalprice) as o_totalprice
  from orders where o_orderpriority is not null group by o_orderpriority),
t as (select * from g order by n desc, o_orderpriority limit 10)
select o_orderpriority, round(o_totalprice, 6) as o_totalprice from t
"""


def _breakdown_part(spark, d):
    part = load(spark, d, "part")
    return rounded(G.breakdown(part, "p_brand", ["p_retailprice", "p_size"], top=10))


def _value_counts_top(spark, d):
    return G.top_categories(load(spark, d, "part"), "p_brand", 10)


def _extremes(spark, d):
    part = load(spark, d, "part")
    return rounded(G.extremes(G.breakdown(part, "p_brand", ["p_retailprice", "p_size"], 10),
                              "p_brand", ["p_retailprice", "p_size"]))


PART_TOP_BRANDS = """
with g as (
  select p_brand, count(*) as n, avg(p_retailprice) as p_retailprice, avg(p_size) as p_size
  from part where p_brand is not null group by p_brand),
t as (select * from g order by n desc, p_brand limit 10)
"""

EXTREMES_SQL = PART_TOP_BRANDS + """
select metric, cast(ordinal as integer) as ordinal, highest, round(highest_value, 6) as highest_value,
       lowest, round(lowest_value, 6) as lowest_value
from (
  select 'p_retailprice' as metric, 0 as ordinal,
         (select p_brand from t order by p_retailprice desc, p_brand limit 1) as highest,
         (select max(p_retailprice) from t) as highest_value,
         (select p_brand from t order by p_retailprice asc, p_brand limit 1) as lowest,
         (select min(p_retailprice) from t) as lowest_value
  union all
  select 'p_size', 1,
         (select p_brand from t order by p_size desc, p_brand limit 1),
         (select max(p_size) from t),
         (select p_brand from t order by p_size asc, p_brand limit 1),
         (select min(p_size) from t)
)
"""


def _filter_top_categories(spark, d):
    """Rows of lineitem whose supplier is among the 10 most frequent."""
    li = load(spark, d, "lineitem")
    kept = G.filter_top_categories(li, "l_suppkey", 10)
    return kept.agg(F.count(F.lit(1)).alias("rows"),
                    F.count_distinct("l_suppkey").alias("suppliers"),
                    F.round(F.sum("l_quantity"), 6).alias("quantity"))


FILTER_TOP_SQL = """
with t as (select l_suppkey from lineitem where l_suppkey is not null
           group by l_suppkey order by count(*) desc, l_suppkey limit 10)
select cast(count(*) as bigint) as rows, cast(count(distinct l_suppkey) as bigint) as suppliers,
       round(sum(l_quantity), 6) as quantity
from lineitem where l_suppkey in (select l_suppkey from t)
"""


def _group_aggregate(spark, d):
    li = load(spark, d, "lineitem")
    return rounded(G.group_aggregate(li, ["l_returnflag"], ["l_quantity", "l_extendedprice"], "mean"))


def _group_aggregate_two(spark, d):
    li = load(spark, d, "lineitem")
    return rounded(G.group_aggregate(li, ["l_returnflag", "l_linestatus"],
                                     ["l_quantity", "l_discount"], "sum"))


def _group_aggregate_median(spark, d):
    orders = load(spark, d, "orders")
    return rounded(G.group_aggregate(orders, ["o_orderstatus"], ["o_totalprice"], "median"))


def _pivot(spark, d):
    orders = load(spark, d, "orders")
    return rounded(G.pivot_aggregate(orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "mean"))


def _pivot_wide(spark, d):
    orders = load(spark, d, "orders")
    long = G.pivot_aggregate(orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "mean")
    return rounded(G.pivot_wide(long, "o_orderpriority", "o_orderstatus"))


def _pareto(spark, d):
    li = load(spark, d, "lineitem")
    return rounded(G.pareto(li, "l_partkey", "l_extendedprice", scale=2))


PARETO_SQL = """
with g as (select l_partkey, coalesce(sum(cast(round(l_extendedprice * 100) as bigint)), 0) as u
           from lineitem where l_partkey is not null group by l_partkey),
r as (select l_partkey, u,
             row_number() over (order by u desc, l_partkey) as rank,
             sum(u) over (order by u desc, l_partkey rows between unbounded preceding and current row) as cum,
             sum(u) over () as total
      from g)
select l_partkey, cast(u as double) / 100.0 as l_extendedprice, cast(rank as bigint) as rank,
       cast(cum as double) / 100.0 as cumulative,
       round(cast(cum as double) * 100.0 / cast(total as double), 6) as cumulative_pct
from r
"""


def _pareto_threshold(spark, d):
    li = load(spark, d, "lineitem")
    return G.pareto_summary(G.pareto(li, "l_partkey", "l_extendedprice", scale=2), 80.0)


PARETO_THRESHOLD_SQL = """
with g as (select l_partkey, coalesce(sum(cast(round(l_extendedprice * 100) as bigint)), 0) as u
           from lineitem where l_partkey is not null group by l_partkey),
r as (select cast(sum(u) over (order by u desc, l_partkey rows between unbounded preceding and current row)
             as double) * 100.0 / cast(sum(u) over () as double) as pct from g)
select cast(count(*) filter (where pct <= 80.0) as bigint) as items_within,
       cast(count(*) as bigint) as total_items from r
"""


def _comparison(spark, d):
    return rounded(G.comparison(load(spark, d, "customer"), "c_mktsegment", "c_acctbal"))


def _sort_desc(spark, d):
    g = G.group_aggregate(load(spark, d, "orders"), ["o_custkey"], ["o_totalprice"], "sum")
    return rounded(W.sort_desc(g, "o_totalprice", "o_custkey"))


def _top_n_rows(spark, d):
    g = G.group_aggregate(load(spark, d, "orders"), ["o_custkey"], ["o_totalprice"], "sum")
    return rounded(W.top_n(g, "o_totalprice", "o_custkey", 10))


def _cumsum(spark, d):
    g = G.group_aggregate(load(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity"], "sum")
    return rounded(W.cumsum(g, [F.desc("l_quantity"), F.asc("l_suppkey")], "l_quantity", "cumulative"))


CUMSUM_SQL = """
with g as (select l_suppkey, sum(l_quantity) as l_quantity from lineitem
           where l_suppkey is not null group by l_suppkey)
select l_suppkey, round(l_quantity, 6) as l_quantity,
       round(sum(l_quantity) over (order by l_quantity desc, l_suppkey
                                   rows between unbounded preceding and current row), 6) as cumulative
from g
"""


def _pct_of_total(spark, d):
    g = G.group_aggregate(load(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity"], "sum")
    return rounded(W.pct_of_total(g, [F.desc("l_quantity"), F.asc("l_suppkey")], "l_quantity"))


PCT_SQL = """
with g as (select l_suppkey, sum(l_quantity) as l_quantity from lineitem
           where l_suppkey is not null group by l_suppkey)
select l_suppkey, round(l_quantity, 6) as l_quantity,
       round(sum(l_quantity) over (order by l_quantity desc, l_suppkey
                                   rows between unbounded preceding and current row)
             * 100.0 / sum(l_quantity) over (), 6) as cumulative_pct
from g
"""

QUERIES = [
    Query("breakdown", _breakdown, BREAKDOWN_SQL),
    Query("breakdown_top10", _breakdown_part, PART_TOP_BRANDS + """
select p_brand, round(p_retailprice, 6) as p_retailprice, round(p_size, 6) as p_size from t"""),
    Query("value_counts_top", _value_counts_top, """
select p_brand, cast(count(*) as bigint) as count from part where p_brand is not null
group by p_brand order by count(*) desc, p_brand limit 10"""),
    Query("breakdown_extremes", _extremes, EXTREMES_SQL),
    Query("filter_top_categories", _filter_top_categories, FILTER_TOP_SQL),
    Query("group_aggregate", _group_aggregate, """
select l_returnflag, round(avg(l_quantity), 6) as l_quantity,
       round(avg(l_extendedprice), 6) as l_extendedprice
from lineitem where l_returnflag is not null group by l_returnflag"""),
    Query("group_aggregate_two_dims", _group_aggregate_two, """
select l_returnflag, l_linestatus, round(sum(l_quantity), 6) as l_quantity,
       round(sum(l_discount), 6) as l_discount
from lineitem where l_returnflag is not null and l_linestatus is not null
group by l_returnflag, l_linestatus"""),
    Query("group_aggregate_median", _group_aggregate_median, """
select o_orderstatus, round(median(o_totalprice), 6) as o_totalprice
from orders where o_orderstatus is not null group by o_orderstatus"""),
    Query("pivot_aggregate", _pivot, """
select o_orderpriority, o_orderstatus, round(avg(o_totalprice), 6) as value
from orders where o_orderpriority is not null and o_orderstatus is not null
group by o_orderpriority, o_orderstatus"""),
    Query("pivot_wide", _pivot_wide, """
select o_orderpriority,
       round(avg(o_totalprice) filter (where o_orderstatus = 'F'), 6) as F,
       round(avg(o_totalprice) filter (where o_orderstatus = 'O'), 6) as O,
       round(avg(o_totalprice) filter (where o_orderstatus = 'P'), 6) as P
from orders where o_orderpriority is not null and o_orderstatus is not null
group by o_orderpriority"""),
    Query("pareto", _pareto, PARETO_SQL),
    Query("pareto_threshold", _pareto_threshold, PARETO_THRESHOLD_SQL),
    Query("comparison", _comparison, """
select c_mktsegment, round(avg(c_acctbal), 6) as mean, cast(count(c_acctbal) as bigint) as count,
       round(sum(c_acctbal), 6) as sum
from customer where c_mktsegment is not null group by c_mktsegment"""),
    Query("sort_desc", _sort_desc, """
select o_custkey, round(sum(o_totalprice), 6) as o_totalprice from orders
where o_custkey is not null group by o_custkey"""),
    Query("top_n_rows", _top_n_rows, """
select o_custkey, round(sum(o_totalprice), 6) as o_totalprice from orders
where o_custkey is not null group by o_custkey order by sum(o_totalprice) desc, o_custkey limit 10"""),
    Query("window_cumsum", _cumsum, CUMSUM_SQL),
    Query("window_pct_of_total", _pct_of_total, PCT_SQL),
]
