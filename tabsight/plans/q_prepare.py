"""Queries for the preparation steps and the ordered pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare as R
from ..operators import stats as S
from ..session import scratch_path
from ..sources.spec import load_spec, save_spec
from .common import rounded
from .registry import Query
from .tables import lineitem_dirty, lineitem_dirty_sql, load

KEYS = ["l_orderkey", "l_linenumber"]


def _cte(masks=(7, 4, 11)) -> str:
    return f"with d as ({lineitem_dirty_sql(masks)})\n"


def _impute(strategy, cols, value=None):
    def build(spark, d):
        df = lineitem_dirty(spark, d).select(*KEYS, *cols)
        return rounded(R.impute(df, cols, strategy, value))
    return build


IMPUTE_MEAN_SQL = _cte() + """
select l_orderkey, l_linenumber,
       round(coalesce(l_discount, (select avg(l_discount) from d)), 6) as l_discount,
       round(coalesce(l_tax, (select avg(l_tax) from d)), 6) as l_tax from d"""

IMPUTE_MEDIAN_SQL = _cte() + """
select l_orderkey, l_linenumber,
       round(coalesce(l_discount, (select quantile_cont(l_discount, 0.5) from d)), 6) as l_discount,
       round(coalesce(l_tax, (select quantile_cont(l_tax, 0.5) from d)), 6) as l_tax from d"""

IMPUTE_MODE_SQL = _cte() + """
select l_orderkey, l_linenumber,
       coalesce(l_returnflag, (select l_returnflag from d where l_returnflag is not null
                               group by l_returnflag order by count(*) desc, l_returnflag limit 1))
         as l_returnflag,
       round(coalesce(l_discount, (select l_discount from d where l_discount is not null
                               group by l_discount order by count(*) desc, l_discount limit 1)), 6)
         as l_discount from d"""

IMPUTE_CONSTANT_SQL = _cte() + """
select l_orderkey, l_linenumber, coalesce(l_returnflag, 'U') as l_returnflag from d"""


def _fillna(spark, d):
    df = lineitem_dirty(spark, d).select(*KEYS, "l_discount", "l_tax", "l_returnflag")
    return rounded(R.fill_missing(df, {"l_discount": 0, "l_tax": "0.5", "l_returnflag": "U"}))


FILLNA_SQL = _cte() + """
select l_orderkey, l_linenumber, round(coalesce(l_discount, 0), 6) as l_discount,
       round(coalesce(l_tax, 0.5), 6) as l_tax, coalesce(l_returnflag, 'U') as l_returnflag from d"""


def _drop_rows(spark, d):
    df = lineitem_dirty(spark, d).select(*KEYS, "l_discount", "l_returnflag")
    return rounded(R.drop_missing_rows(df, ["l_discount", "l_returnflag"]))


DROP_ROWS_SQL = _cte() + """
select l_orderkey, l_linenumber, round(l_discount, 6) as l_discount, l_returnflag from d
where l_discount is not null and l_returnflag is not null"""


def _fillna_widening(spark, d):
    """0.5 into a column of integers: the column becomes double."""
    df = load(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("p_size"))
    return R.fill_missing(df, {"p_size": 0.5})


FILLNA_WIDENING_SQL = """
select p_partkey, case when p_partkey % 4 <> 0 then cast(p_size as double) else 0.5 end as p_size from part"""


def _date_conversion(spark, d):
    df = lineitem_dirty(spark, d).select(*KEYS, "l_shipdate_text", "l_linenumber_text")
    return R.to_datetime(df, ["l_shipdate_text", "l_linenumber_text"])


DATE_CONVERSION_SQL = _cte() + """
select l_orderkey, l_linenumber, try_strptime(l_shipdate_text, '%Y-%m-%d') as l_shipdate_text,
       cast(null as timestamp) as l_linenumber_text from d"""


def _standardize(spark, d):
    df = lineitem_dirty(spark, d).select(*KEYS, "l_quantity", "l_tax")
    return rounded(R.standardize(df, ["l_quantity", "l_tax"]))


STANDARDIZE_SQL = _cte() + """
select l_orderkey, l_linenumber,
       round((l_quantity - (select avg(l_quantity) from d)) / (select stddev_samp(l_quantity) from d), 6)
         as l_quantity,
       round((l_tax - (select avg(l_tax) from d)) / (select stddev_samp(l_tax) from d), 6) as l_tax
from d"""


def _normalize(spark, d):
    df = lineitem_dirty(spark, d).select(*KEYS, "l_extendedprice", "l_discount")
    return rounded(R.normalize(df, ["l_extendedprice", "l_discount"]))


NORMALIZE_SQL = _cte() + """
select l_orderkey, l_linenumber,
       round((l_extendedprice - (select min(l_extendedprice) from d))
             / ((select max(l_extendedprice) from d) - (select min(l_extendedprice) from d)), 6)
         as l_extendedprice,
       round((l_discount - (select min(l_discount) from d))
             / ((select max(l_discount) from d) - (select min(l_discount) from d)), 6) as l_discount
from d"""


def _one_hot(spark, d):
    df = lineitem_dirty(spark, d).select(*KEYS, "l_returnflag", "l_linestatus")
    return R.one_hot(df, ["l_returnflag", "l_linestatus"])


ONE_HOT_SQL = _cte() + """
select l_orderkey, l_linenumber,
       coalesce(l_returnflag = 'A', false) as l_returnflag_A,
       coalesce(l_returnflag = 'N', false) as l_returnflag_N,
       coalesce(l_returnflag = 'R', false) as l_returnflag_R,
       coalesce(l_linestatus = 'F', false) as l_linestatus_F,
       coalesce(l_linestatus = 'O', false) as l_linestatus_O from d"""


def _label(spark, d):
    df = lineitem_dirty(spark, d).select(*KEYS, "l_returnflag", "l_shipdate_text")
    return R.label_encode(df, ["l_returnflag", "l_shipdate_text"])


LABEL_SQL = _cte() + """,
a as (select v, row_number() over (order by v) - 1 as code
      from (select distinct l_returnflag as v from d where l_returnflag is not null)),
b as (select v, row_number() over (order by v) - 1 as code
      from (select distinct l_shipdate_text as v from d where l_shipdate_text is not null))
select l_orderkey, l_linenumber, l_returnflag, l_shipdate_text,
       cast(coalesce(a.code, -1) as bigint) as l_returnflag_encoded,
       cast(coalesce(b.code, -1) as bigint) as l_shipdate_text_encoded
from d left join a on d.l_returnflag = a.v left join b on d.l_shipdate_text = b.v"""

# The explicit step list used by the pipeline queries.
STEPS = [
    {"type": "missing_values", "method": "imputation", "columns": ["l_discount"],
     "parameters": {"strategy": "mean"}},
    {"type": "missing_values", "method": "imputation", "columns": ["l_tax"],
     "parameters": {"strategy": "median"}},
    {"type": "missing_values", "method": "imputation", "columns": ["l_returnflag"],
     "parameters": {"strategy": "mode"}},
    {"type": "date_conversion", "columns": ["l_shipdate_text"]},
    {"type": "standardization", "columns": ["l_quantity"]},
    {"type": "normalization", "columns": ["l_extendedprice", "l_discount"]},
    {"type": "categorical_encoding", "method": "one_hot", "columns": ["l_linestatus"]},
    {"type": "categorical_encoding", "method": "label", "columns": ["l_returnflag", "l_linenumber_text"]},
    {"type": "no_such_step", "columns": ["l_tax"]},
]


def pipeline_sql(masks=(7, 4, 11)) -> str:
    return _cte(masks) + """,
s1 as (select * replace (coalesce(l_discount, (select avg(l_discount) from d)) as l_discount) from d),
s2 as (select * replace (coalesce(l_tax, (select quantile_cont(l_tax, 0.5) from s1)) as l_tax) from s1),
s3 as (select * replace (coalesce(l_returnflag, (select l_returnflag from s2 where l_returnflag is not null
        group by l_returnflag order by count(*) desc, l_returnflag limit 1)) as l_returnflag) from s2),
s4 as (select * replace (try_strptime(l_shipdate_text, '%Y-%m-%d') as l_shipdate_text) from s3),
s5 as (select * replace ((l_quantity - (select avg(l_quantity) from s4))
        / (select stddev_samp(l_quantity) from s4) as l_quantity) from s4),
s6 as (select * replace (
        (l_extendedprice - (select min(l_extendedprice) from s5))
          / ((select max(l_extendedprice) from s5) - (select min(l_extendedprice) from s5)) as l_extendedprice,
        (l_discount - (select min(l_discount) from s5))
          / ((select max(l_discount) from s5) - (select min(l_discount) from s5)) as l_discount) from s5),
s7 as (select * exclude (l_linestatus), coalesce(l_linestatus = 'F', false) as l_linestatus_F,
              coalesce(l_linestatus = 'O', false) as l_linestatus_O from s6),
a as (select v, row_number() over (order by v) - 1 as code
      from (select distinct l_returnflag as v from s7 where l_returnflag is not null)),
b as (select v, row_number() over (order by v) - 1 as code
      from (select distinct l_linenumber_text as v from s7 where l_linenumber_text is not null))
select l_orderkey, l_partkey, l_linenumber, round(l_quantity, 6) as l_quantity,
       round(l_discount, 6) as l_discount, round(l_tax, 6) as l_tax,
       round(l_extendedprice, 6) as l_extendedprice, l_returnflag, l_linenumber_text, l_shipdate_text,
       l_linestatus_F, l_linestatus_O,
       cast(coalesce(a.code, -1) as bigint) as l_returnflag_encoded,
       cast(coalesce(b.code, -1) as bigint) as l_linenumber_text_encoded
from s7 left join a on s7.l_returnflag = a.v left join b on s7.l_linenumber_text = b.v"""


def _pipeline(spark, d):
    return rounded(R.apply_pipeline(lineitem_dirty(spark, d), STEPS))


def _spec_io(spark, d):
    path = scratch_path(spark, "spec")
    save_spec(spark, STEPS, path)
    steps = load_spec(spark, path)
    return rounded(R.apply_pipeline(lineitem_dirty(spark, d), steps))


REPLAY_MASKS = (5, 3, 13)


def _replay(spark, d):
    """The saved spec re-applied to replaced data; its statistics are re-fitted."""
    path = scratch_path(spark, "spec")
    save_spec(spark, STEPS, path)
    return rounded(R.apply_pipeline(lineitem_dirty(spark, d, REPLAY_MASKS), load_spec(spark, path)))


def _stream_replay(spark, d):
    """lineitem_dirty dropped into a folder for each category by one parallel
    write, prepared by the file stream a few files at a time."""
    from ..streaming.replay import read_prepared, replay_stream
    src, sink, ckpt = (scratch_path(spark, n) for n in ("stream-src", "stream-out", "stream-ckpt"))
    dirty = lineitem_dirty(spark, d)
    dirty.withColumn("part", F.col("l_returnflag")).write.partitionBy("part").parquet(src)
    q = replay_stream(spark, f"{src}/*", dirty.schema, STEPS, sink, ckpt, max_files_per_trigger=8)
    q.awaitTermination()
    out = read_prepared(spark, sink)
    return rounded(out.select(*[c for c in out.columns]))


def _before_after(spark, d):
    before = lineitem_dirty(spark, d)
    after = R.apply_pipeline(before, STEPS)
    return rounded(S.before_after_stats(before, after))


def before_after_sql() -> str:
    cols = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    pipe = pipeline_sql()
    parts = []
    for i, c in enumerate(cols):
        parts.append(
            f"select '{c}' as \"column\", cast({i} as integer) as ordinal, "
            f"(select cast(count(*) filter (where {c} is null) as bigint) from d) as missing_before, "
            f"(select cast(count(*) filter (where {c} is null) as bigint) from p) as missing_after, "
            f"(select round(avg({c}), 6) from d) as mean_before, (select round(avg({c}), 6) from p) as mean_after, "
            f"(select round(stddev_samp({c}), 6) from d) as std_before, "
            f"(select round(stddev_samp({c}), 6) from p) as std_after")
    # the after-side statistics are taken on the unrounded pipeline output
    pipe_unrounded = pipe.replace("round(l_quantity, 6)", "l_quantity").replace(
        "round(l_discount, 6)", "l_discount").replace("round(l_tax, 6)", "l_tax").replace(
        "round(l_extendedprice, 6)", "l_extendedprice")
    return (_cte() + f", p as (select * from ({pipe_unrounded}))\n" + "\nunion all\n".join(parts))


QUERIES = [
    Query("impute_mean", _impute("mean", ["l_discount", "l_tax"]), IMPUTE_MEAN_SQL),
    Query("impute_median", _impute("median", ["l_discount", "l_tax"]), IMPUTE_MEDIAN_SQL),
    Query("impute_mode", _impute("mode", ["l_returnflag", "l_discount"]), IMPUTE_MODE_SQL),
    Query("impute_constant", _impute("constant", ["l_returnflag"], "U"), IMPUTE_CONSTANT_SQL),
    Query("fillna", _fillna, FILLNA_SQL),
    Query("fillna_widening", _fillna_widening, FILLNA_WIDENING_SQL),
    Query("drop_missing_rows", _drop_rows, DROP_ROWS_SQL),
    Query("date_conversion", _date_conversion, DATE_CONVERSION_SQL),
    Query("standardize", _standardize, STANDARDIZE_SQL),
    Query("normalize_minmax", _normalize, NORMALIZE_SQL),
    Query("encode_one_hot", _one_hot, ONE_HOT_SQL),
    Query("encode_label", _label, LABEL_SQL),
    Query("apply_pipeline", _pipeline, pipeline_sql()),
    Query("pipeline_spec_io", _spec_io, pipeline_sql()),
    Query("replay_pipeline", _replay, pipeline_sql(REPLAY_MASKS)),
    Query("before_after_stats", _before_after, before_after_sql()),
    Query("stream_replay", _stream_replay, pipeline_sql()),
]
