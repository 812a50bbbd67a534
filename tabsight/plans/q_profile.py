"""Queries for the column profile, quality rules and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT_DATE_FORMATS, NUMERIC_TEXT_PATTERN
from ..operators import profile as P
from ..operators.dates import MONTHS_FULL, MONTHS_SHORT, SHAPE, date_shapes
from ..operators.prepare import to_datetime
from .common import rounded
from .q_stats import DIRTY_ALL, dirty_cte, miss
from .registry import Query
from .tables import lineitem_dirty, load

# Oracle-side spelling of the declared date formats (same order).
DUCK_FORMATS = {
    "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S",
    "yyyy-MM-dd'T'HH:mm:ss": "%Y-%m-%dT%H:%M:%S",
    "yyyy-MM-dd HH:mm": "%Y-%m-%d %H:%M",
    "yyyy-MM-dd": "%Y-%m-%d",
    "yyyy/MM/dd": "%Y/%m/%d",
    "MM/dd/yyyy": "%m/%d/%Y",
    "dd.MM.yyyy": "%d.%m.%Y",
    "yyyyMMdd": "%Y%m%d",
}

DIRTY_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_linenumber": "int",
               "l_quantity": "double", "l_discount": "double", "l_tax": "double",
               "l_extendedprice": "double", "l_returnflag": "string", "l_linestatus": "string",
               "l_linenumber_text": "string", "l_shipdate_text": "string"}


def sql_quote(text: str) -> str:
    return text.replace("'", "''")


def date_format_sql(c: str, source: str = "d") -> str:
    whens = " ".join(
        f"when count({c}) > 0 and count(try_strptime({c}, '{DUCK_FORMATS[f]}')) = count({c}) "
        f"then '{sql_quote(f)}'" for f in DEFAULT_DATE_FORMATS)
    return f"(select case {whens} end from {source})"


def profile_sql() -> str:
    parts = []
    for i, c in enumerate(DIRTY_ALL):
        t = DIRTY_TYPES[c]
        num = t != "string"
        fam = "number" if num else "text"
        stat = (lambda e: f"round({e}({c}), 6)") if num else (lambda e: "cast(null as double)")
        med = f"round(quantile_cont({c}, 0.5), 6)" if num else "cast(null as double)"
        dfmt = date_format_sql(c) if not num else "cast(null as varchar)"
        samples = (f"(select list(v order by v) from (select distinct {c} as v from d "
                   f"where {c} is not null order by v limit 10))") if not num else "cast(null as varchar[])"
        parts.append(
            f"select '{c}' as \"column\", cast({i} as integer) as ordinal, '{t}' as dtype, "
            f"'{fam}' as family, cast(count(*) as bigint) as rows, "
            f"cast(count(*) filter (where {miss(c)}) as bigint) as missing, "
            f"round(count(*) filter (where {miss(c)}) * 100.0 / count(*), 6) as missing_pct, "
            f"cast(count(distinct {c}) as bigint) as n_unique, {stat('min')} as min, "
            f"{stat('max')} as max, {stat('avg')} as mean, {med} as median, "
            f"{stat('stddev_samp')} as std, {dfmt} as date_format, {samples} as samples from d")
    return dirty_cte() + "\nunion all\n".join(parts)


def _profile(spark, d):
    return rounded(P.profile(lineitem_dirty(spark, d)))


def _quality_missing(spark, d):
    return P.quality_missing(lineitem_dirty(spark, d))


def quality_missing_sql() -> str:
    rows = " union all ".join(
        f"select {i} as ord, '{c}' as name, count(*) filter (where {miss(c)}) as miss, "
        f"count(*) as rows from d" for i, c in enumerate(DIRTY_ALL))
    return dirty_cte() + f""", m as ({rows})
select 0 as issue_order, 'missing_values' as type, cast(null as varchar) as "column",
       list(name order by ord) as columns, cast(sum(miss) as bigint) as affected_rows,
       case when max(miss / rows) > 0.2 then 'high' else 'medium' end as severity,
       cast(null as varchar) as suggested_type
from m where miss > 0 having count(*) > 0"""


def _quality_duplicates(spark, d):
    return P.quality_duplicates(load(spark, d, "lineitem").select("l_returnflag", "l_linestatus",
                                                                  "l_quantity"))


QUALITY_DUP_SQL = """
with g as (select count(*) as n from lineitem group by l_returnflag, l_linestatus, l_quantity),
t as (select sum(n) as rows, sum(n - 1) as dup from g)
select 1 as issue_order, 'duplicates' as type, cast(null as varchar) as "column",
       cast(null as varchar[]) as columns, cast(dup as bigint) as affected_rows,
       case when dup / rows > 0.05 then 'medium' else 'low' end as severity,
       cast(null as varchar) as suggested_type
from t where dup > 0
"""


def _quality_outliers(spark, d):
    return P.quality_outliers(load(spark, d, "events"))


def quality_outliers_sql() -> str:
    parts = []
    for c in ("event_id", "user_id", "value"):
        parts.append(f"""
select '{c}' as name, count(*) filter (where {c} < lo or {c} > hi) as n, count(*) as rows
from events, (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi
              from (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from events))""")
    return f"""
with o as ({' union all '.join(parts)})
select 2 as issue_order, 'outliers' as type, name as "column", cast(null as varchar[]) as columns,
       cast(n as bigint) as affected_rows, case when n / rows > 0.05 then 'medium' else 'low' end as severity,
       cast(null as varchar) as suggested_type
from o where n > 0"""


def _quality_numeric_text(spark, d):
    return P.quality_numeric_text(lineitem_dirty(spark, d))


def quality_numeric_text_sql() -> str:
    texts = [c for c in DIRTY_ALL if DIRTY_TYPES[c] == "string"]
    parts = " union all ".join(
        f"select '{c}' as name, count(*) filter (where regexp_matches({c}, '{NUMERIC_TEXT_PATTERN}')) "
        f"as n, count(*) as rows from d" for c in texts)
    return dirty_cte() + f""", t as ({parts})
select 3 as issue_order, 'inconsistent_type' as type, name as "column", cast(null as varchar[]) as columns,
       cast(n as bigint) as affected_rows, 'medium' as severity, 'numeric' as suggested_type
from t where n / rows > 0.5"""


def _date_input(spark, d):
    li = load(spark, d, "lineitem")
    return li.select("l_shipdate", "l_returnflag",
                     F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"),
                     F.date_format("l_shipdate", "MM/dd/yyyy").alias("ship_us"),
                     F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ship_ts"))


def _date_candidates(spark, d):
    return P.date_candidates(_date_input(spark, d))


def date_candidates_sql() -> str:
    src = ("(select l_shipdate, l_returnflag, strftime(l_shipdate, '%Y-%m-%d') as ship_day, "
           "strftime(l_shipdate, '%m/%d/%Y') as ship_us, "
           "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as ship_ts from lineitem)")
    parts = ["select 'l_shipdate' as \"column\", cast(0 as integer) as ordinal, 'datetime' as kind, "
             "cast(null as varchar) as format"]
    for i, c in enumerate(["l_returnflag", "ship_day", "ship_us", "ship_ts"], start=1):
        parts.append(f"select '{c}', cast({i} as integer), 'text', {date_format_sql(c, src)}")
    return "select * from (" + " union all ".join(parts) + ") where format is not null or kind = 'datetime'"


# Dates in forms that no list names: found from their shapes and extremes.
FOUND_FORMATS = {"ship_dmy": ("dd/MM/yyyy", "%d/%m/%Y"), "ship_name": ("MMM d, yyyy", "%b %-d, %Y"),
                 "ship_long": ("d MMMM yyyy", "%-d %B %Y"), "ship_short": ("M/d/yyyy", "%-m/%-d/%Y"),
                 "ship_clock": ("d-M-yyyy h:mm a", "%-d-%-m-%Y %-I:%M %p")}


def _found_input(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        *[F.date_format(F.col("l_shipdate") + F.expr("make_dt_interval(0, l_linenumber * 3, 7)"), f).alias(c)
          for c, (f, _) in FOUND_FORMATS.items()],
        F.when(F.col("l_linenumber") == 1, F.lit("soon")).otherwise(
            F.date_format("l_shipdate", "dd/MM/yyyy")).alias("ship_mixed"))


FOUND_SQL = "with t as (select l_orderkey, l_linenumber, " + ", ".join(
    f"strftime(l_shipdate + to_hours(l_linenumber * 3) + to_minutes(7), '{f}') as {c}"
    for c, (_, f) in FOUND_FORMATS.items()) + (
    ", case when l_linenumber = 1 then 'soon' else strftime(l_shipdate, '%d/%m/%Y') end as ship_mixed from lineitem)")


def _date_shapes(spark, d):
    return date_shapes(_found_input(spark, d), [*FOUND_FORMATS, "ship_mixed"])


def date_shapes_sql() -> str:
    cols = [*FOUND_FORMATS, "ship_mixed"]
    rows = " union all ".join(
        f"select '{c}' as \"column\", cast({i} as integer) as ordinal, {c} as v from t where {c} is not null"
        for i, c in enumerate(cols))
    return FOUND_SQL + f""",
u as ({rows}),
s as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '[0-9]', '9', 'g'),
  '\\b({MONTHS_FULL})\\b', 'F', 'g'), '\\b({MONTHS_SHORT})\\b', 'A', 'g'), '(9 ?)[AP]M$', '\\1P') as g,
  string_split_regex(v, '[^0-9A-Za-z]+') as f from u),
p as (select *, case when regexp_matches(g, '{SHAPE}') then g end as shape,
  case when regexp_matches(g, '{SHAPE}') then try_cast(f[1] as integer) end as f0,
  case when regexp_matches(g, '{SHAPE}') then try_cast(f[2] as integer) end as f1 from s)
select "column", ordinal, shape, count(*) as rows, cast(sum(length(v)) as bigint) as chars,
  max(f0) as max_first, max(f1) as max_second, count(*) filter (where f0 > 12) as high_first,
  count(*) filter (where f1 > 12) as high_second from p group by all"""


def _date_candidates_found(spark, d):
    return P.date_candidates(_found_input(spark, d).drop("l_orderkey", "l_linenumber"))


def date_candidates_found_sql() -> str:
    return FOUND_SQL + " select * from (" + " union all ".join(
        f"select '{c}' as \"column\", cast({i} as integer) as ordinal, 'text' as kind, "
        f"case when count({c}) > 0 and count(try_strptime({c}, '{sql}')) = count({c}) then '{f}' end as format from t"
        for i, (c, (f, sql)) in enumerate([*FOUND_FORMATS.items(), ("ship_mixed", FOUND_FORMATS["ship_dmy"])])
    ) + ") where format is not null"


def _date_conversion_found(spark, d):
    return to_datetime(_found_input(spark, d), [*FOUND_FORMATS, "ship_mixed"])


def date_conversion_found_sql() -> str:
    return FOUND_SQL + " select l_orderkey, l_linenumber, " + ", ".join(
        f"try_strptime({c}, '{sql}') as {c}" for c, (_, sql) in
        [*FOUND_FORMATS.items(), ("ship_mixed", FOUND_FORMATS["ship_dmy"])]) + " from t"


def _suggest(spark, d):
    return P.suggest_preprocessing(P.profile(lineitem_dirty(spark, d), samples=0))


def suggest_sql() -> str:
    prof = profile_sql()
    return f"""
with p as ({prof.replace("with d as", "select * from (with d as", 1)}))
select cast(ordinal as bigint) as seq, 'missing_values' as type, 'imputation' as method, "column",
       case when family = 'number' then 'mean' else 'mode' end as strategy from p where missing > 0
union all
select cast(1000000 + ordinal as bigint), 'date_conversion', cast(null as varchar), "column", date_format
from p where family = 'text' and date_format is not null
union all
select cast(2000000 + ordinal as bigint), 'categorical_encoding',
       case when n_unique < 10 then 'one_hot' else 'label' end, "column", cast(null as varchar)
from p where family = 'text'
"""


EXTRAS = [
    {"type": "missing_values", "method": "imputation", "columns": ["l_quantity", "l_partkey"],
     "parameters": {"strategy": "constant", "value": 0.5}},
    {"type": "normalization", "columns": ["l_tax"], "parameters": {"on_constant": "keep"}},
    {"type": "missing_values", "method": "imputation", "columns": ["l_tax"], "parameters": {"strategy": "median"}},
]


def _suggest_with_extras(spark, d):
    """The third extra is dropped: its column has a suggestion of its type."""
    return P.suggest_preprocessing(P.profile(lineitem_dirty(spark, d), samples=0), EXTRAS)


def suggest_extras_sql() -> str:
    return f"""
select *, ["column"] as columns, cast(null as varchar) as parameters from ({suggest_sql()})
union all
select 3000000, 'missing_values', 'imputation', null, 'constant', ['l_quantity', 'l_partkey'],
       '{{"strategy": "constant", "value": 0.5}}'
union all
select 3000001, 'normalization', null, 'l_tax', null, ['l_tax'], '{{"on_constant": "keep"}}'"""


DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
DOC_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def _profile_documents(spark, d):
    """The profile over whole document texts (distinct texts, samples, date checks)."""
    return rounded(P.profile(load(spark, d, "documents")))


def profile_documents_sql() -> str:
    parts = []
    for i, c in enumerate(DOC_COLS):
        t = DOC_TYPES[c]
        num = t != "string"
        stat = (lambda e: f"round({e}({c}), 6)") if num else (lambda e: "cast(null as double)")
        med = f"round(quantile_cont({c}, 0.5), 6)" if num else "cast(null as double)"
        dfmt = date_format_sql(c, "documents") if not num else "cast(null as varchar)"
        samples = (f"(select list(v order by v) from (select distinct {c} as v from documents "
                   f"where {c} is not null order by v limit 10))") if not num else "cast(null as varchar[])"
        parts.append(
            f"select '{c}' as \"column\", cast({i} as integer) as ordinal, '{t}' as dtype, "
            f"'{'number' if num else 'text'}' as family, cast(count(*) as bigint) as rows, "
            f"cast(count(*) filter (where {c} is null) as bigint) as missing, "
            f"round(count(*) filter (where {c} is null) * 100.0 / count(*), 6) as missing_pct, "
            f"cast(count(distinct {c}) as bigint) as n_unique, {stat('min')} as min, "
            f"{stat('max')} as max, {stat('avg')} as mean, {med} as median, "
            f"{stat('stddev_samp')} as std, {dfmt} as date_format, {samples} as samples from documents")
    return "\nunion all\n".join(parts)


def _numeric_text_documents(spark, d):
    return P.quality_numeric_text(load(spark, d, "documents"))


def numeric_text_documents_sql() -> str:
    parts = " union all ".join(
        f"select '{c}' as name, count(*) filter (where regexp_matches({c}, '{NUMERIC_TEXT_PATTERN}')) "
        f"as n, count(*) as rows from documents" for c in ("text", "lang", "source"))
    return f"""with t as ({parts})
select 3 as issue_order, 'inconsistent_type' as type, name as "column", cast(null as varchar[]) as columns,
       cast(n as bigint) as affected_rows, 'medium' as severity, 'numeric' as suggested_type
from t where n / rows > 0.5"""


def _quality_issues(spark, d):
    return P.quality_issues(lineitem_dirty(spark, d))


def quality_issues_sql() -> str:
    """The four rules over the masked lineitem, in the reference's order."""
    missing_rows = " union all ".join(
        f"select {i} as ord, '{c}' as name, count(*) filter (where {miss(c)}) as miss, "
        f"count(*) as rows from d" for i, c in enumerate(DIRTY_ALL))
    nums = [c for c in DIRTY_ALL if DIRTY_TYPES[c] != "string"]
    outlier_rows = " union all ".join(f"""
select {i} as ord, '{c}' as name, count(*) filter (where {c} < lo or {c} > hi) as n, count(*) as rows
from d, (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi
         from (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from d))"""
                                      for i, c in enumerate(nums))
    texts = [c for c in DIRTY_ALL if DIRTY_TYPES[c] == "string"]
    text_rows = " union all ".join(
        f"select {i} as ord, '{c}' as name, count(*) filter (where regexp_matches({c}, '{NUMERIC_TEXT_PATTERN}')) "
        f"as n, count(*) as rows from d" for i, c in enumerate(texts))
    all_cols = ", ".join(DIRTY_ALL)
    return dirty_cte() + f""", m as ({missing_rows}),
g as (select count(*) as n from d group by {all_cols}),
dup as (select sum(n) as rows, sum(n - 1) as dup from g),
o as ({outlier_rows}),
t as ({text_rows})
select 0 as issue_order, 'missing_values' as type, cast(null as varchar) as "column",
       list(name order by ord) as columns, cast(sum(miss) as bigint) as affected_rows,
       case when max(miss / rows) > 0.2 then 'high' else 'medium' end as severity,
       cast(null as varchar) as suggested_type
from m where miss > 0 having count(*) > 0
union all
select 1, 'duplicates', null, null, cast(dup as bigint),
       case when dup / rows > 0.05 then 'medium' else 'low' end, null from dup where dup > 0
union all
select 2, 'outliers', name, null, cast(n as bigint),
       case when n / rows > 0.05 then 'medium' else 'low' end, null from o where n > 0
union all
select 3, 'inconsistent_type', name, null, cast(n as bigint), 'medium', 'numeric' from t where n / rows > 0.5
"""


QUERIES = [
    Query("profile_table", _profile, profile_sql()),
    Query("quality_missing", _quality_missing, quality_missing_sql()),
    Query("quality_issues", _quality_issues, quality_issues_sql()),
    Query("quality_duplicates", _quality_duplicates, QUALITY_DUP_SQL),
    Query("quality_outliers", _quality_outliers, quality_outliers_sql()),
    Query("quality_numeric_text", _quality_numeric_text, quality_numeric_text_sql()),
    Query("date_candidates", _date_candidates, date_candidates_sql()),
    Query("date_shapes", _date_shapes, date_shapes_sql()),
    Query("date_candidates_found", _date_candidates_found, date_candidates_found_sql()),
    Query("date_conversion_found", _date_conversion_found, date_conversion_found_sql()),
    Query("suggest_preprocessing", _suggest, suggest_sql()),
    Query("suggest_with_extras", _suggest_with_extras, suggest_extras_sql()),
    Query("profile_documents", _profile_documents, profile_documents_sql()),
    Query("quality_numeric_text_documents", _numeric_text_documents, numeric_text_documents_sql()),
]

