"""Queries for projections, filters, filter options and chart series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as COL
from ..operators import predicates as PR
from ..operators import series as SE
from ..operators import correlation as C
from ..operators import grouped as G
from ..sources import sampling as SMP
from .common import rounded
from ..functions.scalars import NUMERIC_TEXT_PATTERN
from .registry import Query
from .tables import lineitem_dirty, lineitem_dirty_sql, load


def _project(spark, d):
    li = load(spark, d, "lineitem")
    return rounded(COL.project(li, ["l_orderkey", "l_linenumber", "l_quantity", "no_such_column"]))


def _select_by_type(spark, d):
    return COL.select_by_type(load(spark, d, "orders"), "text")


def _drop_column(spark, d):
    return rounded(COL.drop_column(load(spark, d, "part"), "p_name"))


def _is_missing(spark, d):
    df = lineitem_dirty(spark, d).select("l_orderkey", "l_linenumber", "l_discount")
    return COL.where_missing(df, "l_discount").select("l_orderkey", "l_linenumber")


def _select(spark, d):
    orders = load(spark, d, "orders")
    return rounded(PR.apply_filters(orders, [{"column": "o_orderstatus", "type": "select", "value": "F"},
                                             {"column": "o_orderpriority", "type": "select",
                                              "value": "All"}]))


def _multiselect(spark, d):
    orders = load(spark, d, "orders")
    return rounded(PR.apply_filters(orders, [
        {"column": "o_orderpriority", "type": "multiselect", "value": ["1-URGENT", "2-HIGH"]},
        {"column": "o_orderstatus", "type": "multiselect", "value": []}]))


def _range(spark, d):
    li = lineitem_dirty(spark, d).select("l_orderkey", "l_linenumber", "l_discount")
    return rounded(PR.apply_filters(li, [{"column": "l_discount", "type": "range", "value": [0.02, 0.05]}]))


def _conjunction(spark, d):
    orders = load(spark, d, "orders")
    f = [{"column": "o_orderstatus", "type": "select", "value": "O"},
         {"column": "o_orderpriority", "type": "multiselect", "value": ["1-URGENT", "3-MEDIUM", "5-LOW"]},
         {"column": "o_totalprice", "type": "range", "value": [50000, 250000]}]
    out = PR.apply_filters(orders, f)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 6).alias("total"))


def _options(spark, d):
    return PR.filter_options(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


def _bounds(spark, d):
    return rounded(PR.filter_bounds(load(spark, d, "orders"), ["o_totalprice", "o_custkey", "o_orderstatus"]))


def _kinds(spark, d):
    return PR.filter_kinds(load(spark, d, "part"), ["p_brand", "p_type", "p_size"])


def _kinds_bounded(spark, d):
    li = load(spark, d, "lineitem")
    return PR.filter_kinds(li, ["l_returnflag", "l_linenumber", "l_quantity", "l_orderkey", "l_shipdate"], counts=False)


KIND_BOUNDED_SQL = " union all ".join(f"""
select '{c}' as "column", case when count(distinct {c}) < 10 then cast(count(distinct {c}) as bigint) end as n_unique,
       case when count(distinct {c}) < 10 then 'select' else 'multiselect' end as kind from lineitem"""
                                      for c in ("l_returnflag", "l_linenumber", "l_quantity", "l_orderkey", "l_shipdate"))


def _bar(spark, d):
    return rounded(SE.series_bar(load(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"]))


def _scatter(spark, d):
    li = load(spark, d, "lineitem")
    li = li.withColumn("ship", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship"]
    return rounded(SE.series_scatter(li, "l_quantity", "l_extendedprice", 500, key))


def _ols(spark, d):
    return rounded(SE.ols(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


def _histogram(spark, d):
    return rounded(SE.histogram(load(spark, d, "events"), "value", 20))


def _heatmap(spark, d):
    li = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    return rounded(SE.series_heatmap(C.correlation(li), "col_x", "col_y", "corr"))


def _heatmap_pivot(spark, d):
    orders = load(spark, d, "orders")
    long = G.pivot_aggregate(orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "sum")
    return rounded(SE.series_heatmap(long, "o_orderpriority", "o_orderstatus", "value"))


def _series_pareto(spark, d):
    return rounded(SE.series_pareto(load(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", 10, scale=2))


def _pie(spark, d):
    return rounded(SE.series_pie(load(spark, d, "customer"), "c_mktsegment", "c_acctbal"))


def _union_head_tail(spark, d):
    """The head and tail of the per-supplier totals, as one frame."""
    g = G.group_aggregate(load(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity"], "sum")
    return rounded(SMP.head_tail(g, ["l_suppkey"], 5))


LONG_LIST = list(range(1, 4003, 2))


def _multiselect_long(spark, d):
    """2,001 whole numbers against a column of doubles."""
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("custkey"))
    return PR.apply_filters(orders, [{"column": "custkey", "type": "multiselect", "value": LONG_LIST}])


def _scalars(spark, d):
    """The scalar helpers over every lineitem row."""
    from ..functions import scalars as SC
    li = lineitem_dirty(spark, d, with_shipdate=True)
    ts = F.col("l_shipdate")
    return rounded(li.select(
        "l_orderkey", "l_linenumber",
        SC.to_numeric(F.col("l_linenumber_text")).alias("as_number"),
        SC.parse_datetime(F.col("l_shipdate_text")).alias("as_time"),
        SC.period_label(ts, "Y").alias("year_end"), SC.period_label(ts, "M").alias("month_end"),
        SC.period_label(ts, "W").alias("week_end"), SC.period_label(ts, "D").alias("day"),
        SC.floor_days(F.lit("1990-01-01 12:00:00").cast("timestamp_ntz"), ts).cast("bigint").alias("days"),
        SC.is_missing(li, "l_discount").alias("discount_missing"),
        SC.safe_div(F.col("l_extendedprice"), F.col("l_discount")).alias("price_per_discount")))


SCALARS_SQL = f"""
with l as ({lineitem_dirty_sql(with_shipdate=True)})
select l_orderkey, l_linenumber,
       case when regexp_matches(l_linenumber_text, '{NUMERIC_TEXT_PATTERN}') then cast(trim(l_linenumber_text) as double) end
         as as_number,
       try_strptime(l_shipdate_text, '%Y-%m-%d') as as_time,
       make_date(year(l_shipdate), 12, 31) as year_end, last_day(l_shipdate) as month_end,
       cast(date_trunc('week', l_shipdate) as date) + 6 as week_end, cast(l_shipdate as date) as day,
       cast(floor(epoch_us(l_shipdate - timestamp '1990-01-01 12:00:00') / 86400000000) as bigint) as days,
       l_discount is null or isnan(l_discount) as discount_missing,
       round(l_extendedprice / nullif(l_discount, 0), 6) as price_per_discount
from l
"""

CORR3 = ["l_quantity", "l_extendedprice", "l_discount"]

HEATMAP_SQL = "\nunion all\n".join(
    f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as z from lineitem"
    for a in CORR3 for b in CORR3)

HIST_SQL = """
with s as (select min(value) as lo, max(value) as hi, avg(value) as mean from events),
c as (select least(cast(floor((value - lo) / (hi - lo) * 20) as integer) + 1, 20) as bin, count(*) as n
      from events, s where value is not null group by 1)
select cast(b as integer) as bin, lo + (b - 1) * ((hi - lo) / 20) as lower, lo + b * ((hi - lo) / 20) as upper,
       cast(coalesce(n, 0) as bigint) as count, round(mean, 6) as mean
from range(1, 21) t(b) cross join s left join c on c.bin = t.b
"""

QUERIES = [
    Query("scalar_functions", _scalars, SCALARS_SQL),
    Query("project_metrics", _project, """
select l_orderkey, l_linenumber, round(l_quantity, 6) as l_quantity from lineitem"""),
    Query("select_by_type", _select_by_type, "select o_orderstatus, o_orderpriority from orders"),
    Query("drop_column", _drop_column, """
select p_partkey, p_brand, p_type, p_size, round(p_retailprice, 6) as p_retailprice from part"""),
    Query("filter_is_missing", _is_missing, f"""
select l_orderkey, l_linenumber from ({lineitem_dirty_sql()}) where l_discount is null or isnan(l_discount)"""),
    Query("filter_select", _select, """
select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) as o_totalprice, o_orderdate,
       o_orderpriority from orders where o_orderstatus = 'F'"""),
    Query("filter_multiselect", _multiselect, """
select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) as o_totalprice, o_orderdate,
       o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')"""),
    Query("filter_multiselect_long", _multiselect_long, """
select o_orderkey, cast(o_custkey as double) as custkey from orders
where o_custkey % 2 = 1 and o_custkey between 1 and 4001"""),
    Query("filter_range", _range, f"""
select l_orderkey, l_linenumber, round(l_discount, 6) as l_discount from ({lineitem_dirty_sql()})
where l_discount between 0.02 and 0.05"""),
    Query("filter_conjunction", _conjunction, """
select cast(count(*) as bigint) as rows, round(sum(o_totalprice), 6) as total from orders
where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '3-MEDIUM', '5-LOW')
  and o_totalprice between 50000 and 250000"""),
    Query("filter_options", _options, """
select distinct 'o_orderstatus' as "column", o_orderstatus as value from orders where o_orderstatus is not null
union all select distinct 'o_orderpriority', o_orderpriority from orders where o_orderpriority is not null
union all select distinct 'o_custkey', cast(o_custkey as varchar) from orders where o_custkey is not null"""),
    Query("filter_bounds", _bounds, """
select 'o_totalprice' as "column", round(min(o_totalprice), 6) as min, round(max(o_totalprice), 6) as max from orders
union all select 'o_custkey', cast(min(o_custkey) as double), cast(max(o_custkey) as double) from orders"""),
    Query("filter_kind", _kinds, """
select "column", n_unique, case when n_unique < 10 then 'select' else 'multiselect' end as kind from (
  select 'p_brand' as "column", cast(count(distinct p_brand) as bigint) as n_unique from part
  union all select 'p_type', cast(count(distinct p_type) as bigint) from part
  union all select 'p_size', cast(count(distinct p_size) as bigint) from part)"""),
    Query("filter_kind_bounded", _kinds_bounded, KIND_BOUNDED_SQL),
    Query("series_bar", _bar, """
select l_returnflag, round(sum(l_quantity), 6) as l_quantity, round(sum(l_extendedprice), 6) as l_extendedprice
from lineitem where l_returnflag is not null group by 1"""),
    Query("series_scatter", _scatter, """
select round(l_quantity, 6) as l_quantity, round(l_extendedprice, 6) as l_extendedprice from lineitem
where l_quantity is not null and l_extendedprice is not null
order by md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                        strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'))) limit 500"""),
    Query("ols_trendline", _ols, """
select round(regr_slope(l_extendedprice, l_quantity), 6) as slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) as intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) as r2,
       cast(regr_count(l_extendedprice, l_quantity) as bigint) as n from lineitem"""),
    Query("histogram", _histogram, HIST_SQL),
    Query("series_heatmap", _heatmap, HEATMAP_SQL),
    Query("series_heatmap_pivot", _heatmap_pivot, """
select o_orderpriority as x, o_orderstatus as y, round(sum(o_totalprice), 6) as z from orders
where o_orderpriority is not null and o_orderstatus is not null group by 1, 2"""),
    Query("series_pareto", _series_pareto, """
with g as (select l_suppkey, coalesce(sum(cast(round(l_extendedprice * 100) as bigint)), 0) as u from lineitem
           where l_suppkey is not null group by 1),
r as (select l_suppkey, u, row_number() over (order by u desc, l_suppkey) as rank,
             sum(u) over (order by u desc, l_suppkey rows between unbounded preceding and current row) as cum,
             sum(u) over () as total from g)
select l_suppkey, cast(u as double) / 100.0 as l_extendedprice, cast(rank as bigint) as rank,
       cast(cum as double) / 100.0 as cumulative,
       round(cast(cum as double) * 100.0 / cast(total as double), 6) as cumulative_pct from r where rank <= 10"""),
    Query("series_pie", _pie, """
select c_mktsegment, round(sum(c_acctbal), 6) as c_acctbal,
       round(sum(c_acctbal) * 100.0 / (select sum(c_acctbal) from customer where c_mktsegment is not null), 6) as pct
from customer where c_mktsegment is not null group by 1"""),
    Query("union_head_tail", _union_head_tail, """
with g as (select l_suppkey, sum(l_quantity) as l_quantity from lineitem where l_suppkey is not null group by 1)
select * from (select l_suppkey, round(l_quantity, 6) as l_quantity from g order by l_suppkey limit 5)
union
select * from (select l_suppkey, round(l_quantity, 6) as l_quantity from g order by l_suppkey desc limit 5)"""),
]
