"""Queries for whole-table statistics, quantiles, outliers and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as C
from ..operators import stats as S
from .common import rounded
from .registry import Query
from .tables import LINEITEM_DIRTY_SQL, lineitem_dirty, load

DIRTY_NUM = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
             "l_extendedprice"]
DIRTY_ALL = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
             "l_extendedprice", "l_returnflag", "l_linestatus", "l_linenumber_text",
             "l_shipdate_text"]
DIRTY_FLOAT = {"l_quantity", "l_discount", "l_tax", "l_extendedprice"}


def dirty_cte() -> str:
    return f"with d as ({LINEITEM_DIRTY_SQL})\n"


def union_sql(cols, select_fn, source="d") -> str:
    """``select ... from source`` for each column, glued with union all."""
    return "\nunion all\n".join(
        f"select {select_fn(c, i)} from {source}" for i, c in enumerate(cols))


def miss(c: str) -> str:
    return f"({c} is null or isnan({c}))" if c in DIRTY_FLOAT else f"{c} is null"


# ------------------------------------------------------------------ shape

def _shape(spark, d):
    return S.shape(load(spark, d, "lineitem"))


def _schema_listing(spark, d):
    return S.schema_listing(load(spark, d, "lineitem"))


SCHEMA_SQL = """
select cast(ordinal_position - 1 as integer) as ordinal, column_name as "column",
       case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int'
                      when 'DOUBLE' then 'double' when 'VARCHAR' then 'string'
                      when 'TIMESTAMP' then 'timestamp_ntz' else lower(data_type) end as dtype,
       case when data_type in ('BIGINT', 'INTEGER', 'DOUBLE') then 'number'
            when data_type = 'VARCHAR' then 'text'
            when data_type = 'TIMESTAMP' then 'datetime' else 'other' end as family
from information_schema.columns where table_name = 'lineitem'
"""


def _missing(spark, d):
    return rounded(S.missing_counts(lineitem_dirty(spark, d)))


MISSING_SQL = dirty_cte() + union_sql(DIRTY_ALL, lambda c, i: (
    f"'{c}' as \"column\", cast({i} as integer) as ordinal, cast(count(*) as bigint) as rows, "
    f"cast(count(*) filter (where {miss(c)}) as bigint) as missing, "
    f"round(count(*) filter (where {miss(c)}) * 100.0 / count(*), 6) as missing_pct"))


def _missing_pct(spark, d):
    m = S.missing_counts(lineitem_dirty(spark, d))
    return m.select("column", F.round("missing_pct", 2).alias("missing_pct"))


MISSING_PCT_SQL = dirty_cte() + union_sql(DIRTY_ALL, lambda c, i: (
    f"'{c}' as \"column\", round(count(*) filter (where {miss(c)}) * 100.0 / count(*), 2) as missing_pct"))


def _unique(spark, d):
    return S.unique_counts(lineitem_dirty(spark, d), hash_texts=["l_shipdate_text"])


UNIQUE_SQL = dirty_cte() + union_sql(DIRTY_ALL, lambda c, i: (
    f"'{c}' as \"column\", cast({i} as integer) as ordinal, "
    f"cast(count(distinct {c}) as bigint) as n_unique"))


def _numeric_stats(spark, d):
    return rounded(S.numeric_stats(lineitem_dirty(spark, d)))


NUMERIC_STATS_SQL = dirty_cte() + union_sql(DIRTY_NUM, lambda c, i: (
    f"'{c}' as \"column\", cast({i} as integer) as ordinal, round(min({c}), 6) as min, "
    f"round(max({c}), 6) as max, round(avg({c}), 6) as mean, "
    f"round(quantile_cont({c}, 0.5), 6) as median, round(stddev_samp({c}), 6) as std"))


def _describe(spark, d):
    return rounded(S.describe(load(spark, d, "lineitem"),
                              ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]))


DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
DESCRIBE_SQL = union_sql(DESCRIBE_COLS, lambda c, i: (
    f"'{c}' as \"column\", cast({i} as integer) as ordinal, cast(count({c}) as bigint) as count, "
    f"round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c}), 6) as min, "
    f"round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.5), 6) as q50, "
    f"round(quantile_cont({c}, 0.75), 6) as q75, round(max({c}), 6) as max"), "lineitem")

DESCRIPTIVE_COLS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _descriptive(spark, d):
    return rounded(S.descriptive(lineitem_dirty(spark, d), DESCRIPTIVE_COLS))


DESCRIPTIVE_SQL = dirty_cte() + union_sql(DESCRIPTIVE_COLS, lambda c, i: (
    f"'{c}' as \"column\", cast({i} as integer) as ordinal, cast(count({c}) as bigint) as count, "
    f"round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c}), 6) as min, "
    f"round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.5), 6) as q50, "
    f"round(quantile_cont({c}, 0.75), 6) as q75, round(max({c}), 6) as max, "
    f"cast(count(*) filter (where {miss(c)}) as bigint) as missing, "
    f"round(round(count(*) filter (where {miss(c)}) * 100.0 / count(*), 2), 6) as missing_pct"))


def _kpi(spark, d):
    return rounded(S.kpi(load(spark, d, "orders"), ["o_totalprice"]))


KPI_SQL = """
select 'o_totalprice' as "column", cast(0 as integer) as ordinal, round(avg(o_totalprice), 6) as mean,
       round(min(o_totalprice), 6) as min, round(max(o_totalprice), 6) as max,
       round(stddev_samp(o_totalprice), 6) as std from orders
"""

QUANTILE_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]
QUANTILE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _quantiles(spark, d):
    return rounded(S.quantiles(load(spark, d, "lineitem"), QUANTILE_COLS, QUANTILE_PROBS))


QUANTILES_SQL = "\nunion all\n".join(
    f"select '{c}' as \"column\", cast({p} as double) as prob, round(quantile_cont({c}, {p}), 6) as value "
    f"from lineitem" for c in QUANTILE_COLS for p in QUANTILE_PROBS)


MODE_COLS = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]


def _mode(spark, d):
    return S.mode_value(lineitem_dirty(spark, d), MODE_COLS)


MODE_SQL = dirty_cte() + "\nunion all\n".join(
    f"select '{c}' as \"column\", cast({i} as integer) as ordinal, cast(v as varchar) as value, "
    f"cast(n as bigint) as count from (select {c} as v, count(*) as n from d where not {miss(c)} "
    f"group by {c} order by count(*) desc, {c} limit 1)" for i, c in enumerate(MODE_COLS))


def _duplicates(spark, d):
    li = load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return S.duplicate_rows(li)


DUPLICATES_SQL = """
select cast(sum(n) as bigint) as rows, cast(sum(n - 1) as bigint) as duplicates
from (select count(*) as n from lineitem group by l_returnflag, l_linestatus, l_quantity)
"""


def _duplicate_documents(spark, d):
    """Exact copies among whole document texts (hash-first, exact)."""
    return S.duplicate_rows(load(spark, d, "documents").select("text"))


DUPLICATE_DOCUMENTS_SQL = """
select cast(sum(n) as bigint) as rows, cast(sum(n - 1) as bigint) as duplicates
from (select count(*) as n from documents group by text)
"""


def _mode_documents(spark, d):
    """Modes over whole document texts (hash-first, exact)."""
    cols = ["text", "lang", "source"]
    return S.mode_value(load(spark, d, "documents"), cols, hash_texts=cols)


MODE_DOCUMENTS_SQL = "\nunion all\n".join(
    f"select '{c}' as \"column\", cast({i} as integer) as ordinal, v as value, cast(n as bigint) as count "
    f"from (select {c} as v, count(*) as n from documents where {c} is not null group by {c} "
    f"order by count(*) desc, {c} limit 1)" for i, c in enumerate(["text", "lang", "source"]))


def _samples(spark, d):
    return S.column_samples(load(spark, d, "customer"), ["c_name", "c_mktsegment"], 10)


SAMPLES_SQL = """
select 'c_name' as "column", list(v order by v) as samples
from (select distinct c_name as v from customer where c_name is not null order by v limit 10)
union all
select 'c_mktsegment', list(v order by v)
from (select distinct c_mktsegment as v from customer where c_mktsegment is not null order by v limit 10)
"""

CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_const"]


def _corr_input(spark, d):
    li = load(spark, d, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     F.lit(1.0).cast("double").alias("l_const"))


def _correlation(spark, d):
    return rounded(C.correlation(_corr_input(spark, d)))


CORR_SOURCE = ("(select l_quantity, l_extendedprice, l_discount, l_tax, "
               "cast(1 as double) as l_const from lineitem)")


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j, b in enumerate(CORR_COLS):
            lo, hi = (a, b) if i <= j else (b, a)
            parts.append(
                f"select '{a}' as col_x, '{b}' as col_y, cast({i} as integer) as x_ordinal, "
                f"cast({j} as integer) as y_ordinal, "
                f"round(case when isnan(corr({lo}, {hi})) then null else corr({lo}, {hi}) end, 6) as corr, "
                f"cast(count(*) filter (where {a} is not null and {b} is not null) as bigint) as n "
                f"from {CORR_SOURCE}")
    return "\nunion all\n".join(parts)


# Twenty columns, each missing in its own rows: 210 pairs, beyond one generated aggregate.
WIDE_CORR = {f"{c}_{m}": (c, m) for c in CORR_COLS[:4] for m in (3, 5, 7, 11, 13)}


def _correlation_wide(spark, d):
    li = load(spark, d, "lineitem")
    return rounded(C.correlation(li.select(*[
        F.when((F.col("l_orderkey") + F.col("l_linenumber") * m) % m != i % m, F.col(c) * F.col("l_linenumber")).alias(name)
        for i, (name, (c, m)) in enumerate(WIDE_CORR.items())])))


def _corr_wide_sql() -> str:
    names = list(WIDE_CORR)
    cols = ", ".join(f"case when (l_orderkey + l_linenumber * {m}) % {m} <> {i % m} then {c} * l_linenumber end as {name}"
                     for i, (name, (c, m)) in enumerate(WIDE_CORR.items()))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    aggs = ", ".join(f"corr({names[i]}, {names[j]}) as r_{i}_{j}, "
                     f"count(*) filter (where {names[i]} is not null and {names[j]} is not null) as n_{i}_{j}"
                     for i, j in pairs)
    rows = " union all ".join(
        f"select '{names[x]}' as col_x, '{names[y]}' as col_y, cast({x} as integer) as x_ordinal, "
        f"cast({y} as integer) as y_ordinal, round(r_{i}_{j}, 6) as corr, n_{i}_{j} as n from a"
        for i, j in pairs for x, y in sorted({(i, j), (j, i)}))
    return f"with t as (select {cols} from lineitem), a as materialized (select {aggs} from t) {rows}"


def _corr_pairs(spark, d):
    return C.correlation_pairs(_corr_input(spark, d))


def _corr_pairs_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j, b in enumerate(CORR_COLS):
            if i != j:
                lo, hi = (a, b) if i < j else (b, a)
                parts.append(f"select '{a}' as col_x, '{b}' as col_y, round(corr({lo}, {hi}), 2) as corr "
                             f"from {CORR_SOURCE} having not isnan(corr({lo}, {hi}))")
    return "\nunion all\n".join(parts)


def _top_corr(spark, d):
    return C.top_correlations(C.correlation(_corr_input(spark, d)), 3)


def _top_corr_sql() -> str:
    pairs = []
    for i, a in enumerate(CORR_COLS):
        for j, b in enumerate(CORR_COLS):
            if i < j:
                pairs.append(f"select '{a}' as col_x, '{b}' as col_y, {i} as xi, {j} as yi, "
                             f"case when isnan(corr({a}, {b})) then null else corr({a}, {b}) end as c "
                             f"from {CORR_SOURCE}")
    return f"""
with p as ({' union all '.join(pairs)}),
r as (select col_x, col_y, xi, yi, round(c, 2) as r from p where c is not null)
select col_x, col_y, r,
       case when r > 0 then 'positive' else 'negative' end as direction,
       case when abs(r) > 0.7 then 'strong' when abs(r) > 0.3 then 'moderate' else 'weak' end as strength
from r where r <> 0 order by abs(r) desc, xi, yi limit 3
"""


def _strongest(spark, d):
    return rounded(C.strongest_pair(C.correlation(_corr_input(spark, d)),
                                    ["l_quantity", "l_extendedprice", "l_discount"]))


def _strongest_sql() -> str:
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                pairs.append(f"select '{a}' as col_x, '{b}' as col_y, {i} as xi, {j} as yi, "
                             f"corr({a}, {b}) as c, count(*) filter (where {a} is not null and "
                             f"{b} is not null) as n from lineitem")
    return f"""
with p as ({' union all '.join(pairs)})
select col_x, col_y, round(c, 6) as corr, cast(n as bigint) as n from p
where c is not null and not isnan(c) order by abs(c) desc, xi, yi limit 1
"""


DIST_COLS = ["value"]


def _distribution(spark, d):
    ev = load(spark, d, "events")
    li = load(spark, d, "lineitem")
    a = S.distribution(ev, ["value", "user_id"])
    b = S.distribution(li.select("l_quantity", "l_discount", F.lit(2.0).alias("l_const")),
                       ["l_quantity", "l_discount", "l_const"])
    return rounded(a.unionByName(b))


def _dist_sql(table, cols) -> str:
    return "\nunion all\n".join(
        f"select '{c}' as \"column\", cast({i} as integer) as ordinal, round(avg({c}), 6) as mean, "
        f"round(quantile_cont({c}, 0.5), 6) as median, "
        f"round(case when count({c}) < 3 then null when min({c}) = max({c}) then 0.0 "
        f"else skewness({c}) end, 6) as skew, "
        f"case when count({c}) < 3 then null when min({c}) = max({c}) then 'symmetrical' "
        f"when abs(skewness({c})) < 0.5 then 'symmetrical' when skewness({c}) > 0 then 'right-skewed' "
        f"else 'left-skewed' end as shape from {table}" for i, c in enumerate(cols))


DISTRIBUTION_SQL = (_dist_sql("events", ["value", "user_id"]) + "\nunion all\n"
                    + _dist_sql("(select l_quantity, l_discount, 2.0::double as l_const from lineitem)",
                                ["l_quantity", "l_discount", "l_const"]))


def _iqr(spark, d):
    return rounded(S.iqr_outliers(load(spark, d, "events"), ["value", "user_id"]))


def _iqr_sql(cols, table) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"""
select '{c}' as "column", cast({i} as integer) as ordinal, cast(count(*) as bigint) as rows,
       round(q1, 6) as q1, round(q3, 6) as q3, round(lo, 6) as lower, round(hi, 6) as upper,
       cast(count(*) filter (where {c} < lo or {c} > hi) as bigint) as outliers,
       round(min({c}) filter (where {c} >= lo), 6) as whisker_low,
       round(max({c}) filter (where {c} <= hi), 6) as whisker_high
from {table}, (select q1, q3, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi
               from (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {table}))
group by q1, q3, lo, hi""")
    return "\nunion all\n".join(parts)


def _box(spark, d):
    return rounded(S.box_stats(load(spark, d, "events"), ["value"]))


BOX_SQL = """
with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as med,
                  quantile_cont(value, 0.75) as q3 from events),
f as (select q1, med, q3, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)
select 'value' as "column", cast(0 as integer) as ordinal, round(q1, 6) as q1, round(med, 6) as median,
       round(q3, 6) as q3, round(lo, 6) as lower, round(hi, 6) as upper,
       round(min(value) filter (where value >= lo), 6) as whisker_low,
       round(max(value) filter (where value <= hi), 6) as whisker_high,
       cast(count(*) filter (where value < lo or value > hi) as bigint) as outliers
from events, f group by q1, med, q3, lo, hi
"""

def _describe_datetime(spark, d):
    return S.describe_datetime(load(spark, d, "orders"))


DESCRIBE_DATETIME_SQL = """
with m as (select epoch_us(o_orderdate) as v from orders)
select 'o_orderdate' as "column", cast(0 as integer) as ordinal, cast(count(v) as bigint) as count,
       make_timestamp(cast(floor(avg(v)) as bigint)) as mean,
       make_timestamp(cast(floor(min(v)) as bigint)) as min,
       make_timestamp(cast(floor(quantile_cont(v, 0.25)) as bigint)) as q25,
       make_timestamp(cast(floor(quantile_cont(v, 0.5)) as bigint)) as q50,
       make_timestamp(cast(floor(quantile_cont(v, 0.75)) as bigint)) as q75,
       make_timestamp(cast(floor(max(v)) as bigint)) as max
from m
"""


def _describe_text(spark, d):
    return S.describe_text(load(spark, d, "orders"))


def describe_text_sql() -> str:
    cols = {"o_orderstatus": 0, "o_orderpriority": 1}
    return "\nunion all\n".join(f"""
select '{c}' as "column", cast({i} as integer) as ordinal,
       (select cast(count({c}) as bigint) from orders) as count,
       (select cast(count(distinct {c}) as bigint) from orders) as unique,
       top, cast(freq as bigint) as freq
from (select {c} as top, count(*) as freq from orders where {c} is not null group by 1
      order by count(*) desc, 1 limit 1)""" for c, i in cols.items())


QUERIES = [
    Query("dataset_shape", _shape, "select cast(count(*) as bigint) as rows, cast(11 as bigint) as columns from lineitem"),
    Query("schema_listing", _schema_listing, SCHEMA_SQL),
    Query("missing_counts", _missing, MISSING_SQL),
    Query("missing_pct", _missing_pct, MISSING_PCT_SQL),
    Query("unique_counts", _unique, UNIQUE_SQL),
    Query("numeric_stats", _numeric_stats, NUMERIC_STATS_SQL),
    Query("describe", _describe, DESCRIBE_SQL),
    Query("descriptive", _descriptive, DESCRIPTIVE_SQL),
    Query("describe_datetime", _describe_datetime, DESCRIBE_DATETIME_SQL),
    Query("describe_text", _describe_text, describe_text_sql()),
    Query("kpi", _kpi, KPI_SQL),
    Query("quantiles", _quantiles, QUANTILES_SQL),
    Query("mode_value", _mode, MODE_SQL),
    Query("duplicate_rows", _duplicates, DUPLICATES_SQL),
    Query("duplicate_documents", _duplicate_documents, DUPLICATE_DOCUMENTS_SQL),
    Query("mode_documents", _mode_documents, MODE_DOCUMENTS_SQL),
    Query("column_samples", _samples, SAMPLES_SQL),
    Query("correlation_matrix", _correlation, _corr_sql()),
    Query("correlation_wide", _correlation_wide, _corr_wide_sql()),
    Query("correlation_pairs", _corr_pairs, _corr_pairs_sql()),
    Query("top_correlations", _top_corr, _top_corr_sql()),
    Query("strongest_pair", _strongest, _strongest_sql()),
    Query("distribution", _distribution, DISTRIBUTION_SQL),
    Query("predicate_iqr_outlier", _iqr, _iqr_sql(["value", "user_id"], "events")),
    Query("box_stats", _box, BOX_SQL),
]
