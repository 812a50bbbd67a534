"""Queries for column roles, domain detection and analysis suggestions over
the catalog of the driver tables (facts read from the full tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as K
from .common import rounded
from .q_stats import CORR_COLS, DESCRIPTIVE_COLS
from .registry import Query
from .tables import TABLES, load

CATALOG_TABLES = TABLES

# Oracle-side column lists of the catalog tables (as in the test data schema).
ORACLE_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def _tables(spark, d):
    return {t: load(spark, d, t) for t in CATALOG_TABLES}


def _facts(spark, d):
    return K.catalog_facts(spark, _tables(spark, d))


def _classify(spark, d):
    return K.classify_columns(_facts(spark, d))


def facts_sql() -> str:
    counts = "\nunion all\n".join(
        f"select '{t}' as tbl, '{c}' as col, count(*) as rows, count(*) filter (where {c} is null) as missing, "
        f"count(distinct {c}) as n_unique from {t}"
        for t, cols in ORACLE_COLUMNS.items() for c in cols)
    tables = ", ".join(f"'{t}'" for t in CATALOG_TABLES)
    return f"""
with c as (
  select table_name as "table", column_name as "column", cast(ordinal_position - 1 as integer) as ordinal,
         case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double'
                        when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz'
                        when 'FLOAT[]' then 'array<float>' else lower(data_type) end as dtype,
         case when data_type in ('BIGINT', 'INTEGER', 'DOUBLE') then 'number'
              when data_type = 'VARCHAR' then 'text' when data_type = 'TIMESTAMP' then 'datetime'
              else 'other' end as family
  from information_schema.columns where table_name in ({tables})),
n as ({counts}),
f as (select c.*, cast(n.rows as bigint) as rows, cast(n.missing as bigint) as missing,
             cast(n.n_unique as bigint) as n_unique
      from c left join n on c."table" = n.tbl and c."column" = n.col)
"""


def classify_sql() -> str:
    entity = " or ".join(f"contains(lower(\"column\"), '{k}')" for k in K.ENTITY_KEYWORDS)
    return facts_sql() + f"""
select *, family = 'number' as is_metric, family = 'text' as is_dimension, family = 'datetime' as is_time,
       ({entity}) as is_entity,
       case when family = 'datetime' then 'time' when family = 'number' then 'metric'
            when family = 'text' then 'dimension' else 'other' end as role
from f"""


def _domain(spark, d):
    return _with_rows(K.detect_domain(K.column_catalog(spark, _tables(spark, d))), spark, d)


def _with_rows(per_table, spark, d):
    """Each table's row count beside what its column names say."""
    return per_table.join(K.table_rows(spark, _tables(spark, d)), "table")


def rows_sql() -> str:
    return " union all ".join(f"select '{t}' as \"table\", cast(count(*) as bigint) as rows from {t}"
                              for t in CATALOG_TABLES)


def keyword_values_sql() -> str:
    return ", ".join(f"('{dname}', {i}, '{k}')" for i, (dname, ks) in enumerate(K.DOMAIN_KEYWORDS.items())
                     for k in ks)


def domain_sql() -> str:
    return facts_sql() + f""",
kw as (select * from (values {keyword_values_sql()}) t(domain, domain_ordinal, keyword)),
h as (select f."table", kw.domain, kw.domain_ordinal, count(*) as score
      from f join kw on contains(lower(f."column"), kw.keyword)
      group by 1, 2, 3),
b as (select "table", arg_min(domain, [-score, domain_ordinal]) as domain, max(score) as score
      from h group by 1)
select t."table", coalesce(b.domain, 'unknown') as domain, cast(coalesce(b.score, 0) as bigint) as score, r.rows
from (select distinct "table" from f) t left join b using ("table") join ({rows_sql()}) r using ("table")
"""


def _suggest(spark, d):
    cat = K.column_catalog(spark, _tables(spark, d))
    return _with_rows(K.suggest_analyses(K.classify_columns(cat), K.detect_domain(cat)), spark, d)


def suggest_sql() -> str:
    base = domain_sql().rstrip()
    # reuse the CTEs of domain_sql and add the per-table role lists
    head, _, tail = base.rpartition("select t.\"table\"")
    return head.rstrip() + f""",
dom as (select t."table", coalesce(b.domain, 'unknown') as domain
        from (select distinct "table" from f) t left join b using ("table")),
p as (select "table",
             coalesce(list("column" order by ordinal) filter (where family = 'number'), []) as m,
             coalesce(list("column" order by ordinal) filter (where family = 'text'), []) as dm,
             coalesce(list("column" order by ordinal) filter (where family = 'datetime'), []) as tm,
             min("column") filter (where lower("column") = 'product') as product,
             min("column") filter (where lower("column") = 'revenue') as revenue,
             min("column") filter (where lower("column") = 'campaign') as campaign,
             min("column") filter (where lower("column") = 'conversion') as conversion
      from f group by 1),
q as (select p.*, dom.domain from p left join dom using ("table"))
select * from (select "table", 0 as seq, 'descriptive' as analysis, m as metrics, cast([] as varchar[]) as dimensions,
       cast(null as varchar) as aggregation from q where len(m) > 0
union all select "table", 1, 'time_series', m[1:3], tm[1:1], null from q where len(m) > 0 and len(tm) > 0
union all select "table", 2, 'breakdown', m[1:2], dm[1:1], null from q where len(m) > 0 and len(dm) > 0
union all select "table", 3, 'breakdown', m[1:2], dm[2:2], null from q where len(m) > 0 and len(dm) > 1
union all select "table", 4, 'correlation', m[1:5], [], null from q where len(m) >= 2
union all select "table", 5, 'distribution', m[1:3], [], null from q where len(m) > 0
union all select "table", 6, 'pareto', [revenue], [product], null from q
  where domain = 'sales' and product is not null and revenue is not null
union all select "table", 7, 'comparison', [conversion], [campaign], null from q
  where domain = 'marketing' and campaign is not null and conversion is not null
union all select "table", 8, 'grouping', m[1:2], dm[1:2], 'mean' from q where len(m) > 0 and len(dm) > 0)
join ({rows_sql()}) using ("table")
"""


def _run_analysis(spark, d):
    """The grouping analysis suggested for orders, run on orders."""
    cat = K.column_catalog(spark, _tables(spark, d))
    sugg = K.suggest_analyses(K.classify_columns(cat), K.detect_domain(cat))
    row = sugg.where((F.col("table") == "orders") & (F.col("analysis") == "grouping")).first()
    config = {"type": row["analysis"], "metrics": list(row["metrics"]),
              "dimensions": list(row["dimensions"]), "parameters": {"aggregation": row["aggregation"]}}
    return rounded(K.run_analysis(load(spark, d, "orders"), config)["data"])


RUN_ANALYSIS_SQL = """
select o_orderstatus, o_orderpriority, 'o_orderkey' as metric, round(avg(o_orderkey), 6) as value from orders
where o_orderstatus is not null and o_orderpriority is not null group by 1, 2
union all
select o_orderstatus, o_orderpriority, 'o_custkey', round(avg(o_custkey), 6) from orders
where o_orderstatus is not null and o_orderpriority is not null group by 1, 2
"""


def _run(table, config, part="data"):
    return lambda spark, d: rounded(K.run_analysis(load(spark, d, table), config)[part])


def _run_distribution(spark, d):
    out = K.run_analysis(load(spark, d, "lineitem"), {"type": "distribution", "metrics": ["l_quantity", "l_tax"]})
    both = None
    for m, h in out["histograms"].items():
        one = h.select(F.lit(m).alias("metric"), "bin", "count")
        both = one if both is None else both.unionByName(one)
    return both


def run_distribution_sql() -> str:
    return " union all ".join(f"""
select '{m}' as metric, cast(b.bin as integer) as bin, cast(coalesce(c.n, 0) as bigint) as count
from range(1, 21) b(bin) left join (
  select least(cast(floor(({m} - lo) / (hi - lo) * 20) as integer) + 1, 20) as bin, count(*) as n
  from lineitem, (select min({m}) as lo, max({m}) as hi from lineitem) where {m} is not null group by 1) c
  using (bin)""" for m in ("l_quantity", "l_tax"))


RUN_COMPARISON_SQL = " union all ".join(f"""
select o_orderpriority, '{m}' as metric, round(avg({m}), 6) as mean, cast(count({m}) as bigint) as count,
       round(cast(sum({m}) as double), 6) as sum
from orders where o_orderpriority is not null group by 1""" for m in ("o_totalprice", "o_custkey"))

RUN_PARETO_SQL = " union all ".join(f"""
select '{m}' as metric, l_suppkey, round(u, 6) as value,
       cast(row_number() over (order by u desc, l_suppkey) as bigint) as rank
from (select l_suppkey, sum({m}) as u from lineitem where l_suppkey is not null group by 1)"""
                                for m in ("l_quantity", "l_linenumber"))


def _run_pareto(spark, d):
    out = K.run_analysis(load(spark, d, "lineitem"), {"type": "pareto", "metrics": ["l_quantity", "l_linenumber"],
                                                      "dimensions": ["l_suppkey"]})["data"]
    return rounded(out.select("metric", "l_suppkey", "value", "rank"))


RUN_BREAKDOWN_SQL = """
with g as (select o_orderpriority, count(*) as n, avg(o_totalprice) as o_totalprice, avg(o_custkey) as o_custkey
           from orders where o_orderpriority is not null group by 1)
select o_orderpriority, round(o_totalprice, 6) as o_totalprice, round(o_custkey, 6) as o_custkey
from (select * from g order by n desc, o_orderpriority limit 10)
"""

RUN_TREND_SQL = """
with g as (select make_date(year(o_orderdate), 12, 31) as period, avg(o_totalprice) as o_totalprice
           from orders where o_orderdate is not null group by 1)
select period, round(o_totalprice, 6) as o_totalprice from g
"""

RUN_DESCRIPTIVE_SQL = " union all ".join(f"""
select '{c}' as "column", cast({i} as integer) as ordinal, cast(count({c}) as bigint) as count, round(avg({c}), 6) as mean,
       round(stddev_samp({c}), 6) as std, round(min({c}), 6) as min, round(quantile_cont({c}, 0.25), 6) as q25,
       round(quantile_cont({c}, 0.5), 6) as q50, round(quantile_cont({c}, 0.75), 6) as q75, round(max({c}), 6) as max,
       cast(count(*) - count({c}) as bigint) as missing,
       round(round((count(*) - count({c})) * 100.0 / count(*), 2), 6) as missing_pct from lineitem"""
                                         for i, c in enumerate(DESCRIPTIVE_COLS))


def _run_correlation(spark, d):
    out = K.run_analysis(load(spark, d, "lineitem"), {"type": "correlation", "metrics": CORR_COLS[:4]})
    return rounded(out["data"])


RUN_CORRELATION_SQL = " union all ".join(f"""
select '{a}' as col_x, '{b}' as col_y, cast({i} as integer) as x_ordinal, cast({j} as integer) as y_ordinal,
       round(corr({a}, {b}), 6) as corr, cast(count(*) filter (where {a} is not null and {b} is not null) as bigint) as n
from lineitem""" for i, a in enumerate(CORR_COLS[:4]) for j, b in enumerate(CORR_COLS[:4]))

QUERIES = [
    Query("classify_columns", _classify, classify_sql()),
    Query("detect_domain", _domain, domain_sql()),
    Query("suggest_analyses", _suggest, suggest_sql()),
    Query("run_analysis", _run_analysis, RUN_ANALYSIS_SQL),
    Query("run_comparison", _run("orders", {"type": "comparison", "metrics": ["o_totalprice", "o_custkey"],
                                            "dimensions": ["o_orderpriority"]}), RUN_COMPARISON_SQL),
    Query("run_pareto", _run_pareto, RUN_PARETO_SQL),
    Query("run_breakdown", _run("orders", {"type": "breakdown", "metrics": ["o_totalprice", "o_custkey"],
                                           "dimensions": ["o_orderpriority"]}), RUN_BREAKDOWN_SQL),
    Query("run_descriptive", _run("lineitem", {"type": "descriptive", "metrics": DESCRIPTIVE_COLS}), RUN_DESCRIPTIVE_SQL),
    Query("run_correlation", _run_correlation, RUN_CORRELATION_SQL),
    Query("run_distribution", _run_distribution, run_distribution_sql()),
    Query("run_time_series", _run("orders", {"type": "time_series", "metrics": ["o_totalprice"],
                                             "dimensions": ["o_orderdate"]}), RUN_TREND_SQL),
]
