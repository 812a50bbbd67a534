"""Queries for calendar resampling, frequency choice, trend and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as SE
from ..operators import timeseries as TS
from ..operators import windows as W
from .common import rounded
from .registry import Query
from .tables import load

GAP_FILTER = "not (ts between '2024-01-08' and '2024-01-15')"


def _events_gap(spark, d):
    """All rows of events, with the numbers of the second week blanked: the
    periods of that week stay and have no mean."""
    ev = load(spark, d, "events")
    return ev.withColumns({c: F.when(F.expr(GAP_FILTER), F.col(c)) for c in ("value", "user_id")})


EVENTS_GAP_SQL = f"""select * replace (case when {GAP_FILTER} then value end as value,
                  case when {GAP_FILTER} then user_id end as user_id) from events"""


def _auto_freq_orders(spark, d):
    return TS.auto_frequency(load(spark, d, "orders"), "o_orderdate")


def _auto_freq_events(spark, d):
    return TS.auto_frequency(load(spark, d, "events"), "ts")


def auto_freq_sql(table, col) -> str:
    return f"""
select min({col}) as min_ts, max({col}) as max_ts,
       cast(floor(epoch_us(max({col}) - min({col})) / 86400000000) as bigint) as span_days,
       case when floor(epoch_us(max({col}) - min({col})) / 86400000000) > 730 then 'Y'
            when floor(epoch_us(max({col}) - min({col})) / 86400000000) > 90 then 'M'
            when floor(epoch_us(max({col}) - min({col})) / 86400000000) > 21 then 'W' else 'D' end as frequency
from {table}"""


def _resample_year(spark, d):
    return rounded(TS.resample(load(spark, d, "orders"), "o_orderdate", ["o_totalprice"], "auto"))


RESAMPLE_YEAR_SQL = """
with g as (select make_date(year(o_orderdate), 12, 31) as period, avg(o_totalprice) as v
           from orders where o_orderdate is not null group by 1),
s as (select make_date(y, 12, 31) as period
      from range((select min(year(period)) from g), (select max(year(period)) from g) + 1) t(y))
select s.period, round(g.v, 6) as o_totalprice from s left join g using (period)
"""


def _resample_month(spark, d):
    return rounded(TS.resample(load(spark, d, "orders"), "o_orderdate", ["o_totalprice"], "M"))


RESAMPLE_MONTH_SQL = """
with g as (select last_day(o_orderdate) as period, avg(o_totalprice) as v from orders
           where o_orderdate is not null group by 1),
s as (select last_day(cast(m as date)) as period
      from range(date_trunc('month', (select min(period) from g)),
                 date_trunc('month', (select max(period) from g)) + interval 1 month,
                 interval 1 month) t(m))
select s.period, round(g.v, 6) as o_totalprice from s left join g using (period)
"""


def _resample_week(spark, d):
    return rounded(TS.resample(_events_gap(spark, d), "ts", ["value", "user_id"], "auto"))


def week_sql(metrics) -> str:
    aggs = ", ".join(f"avg({m}) as {m}" for m in metrics)
    outs = ", ".join(f"round(g.{m}, 6) as {m}" for m in metrics)
    return f"""
with e as ({EVENTS_GAP_SQL}),
g as (select cast(date_trunc('week', ts) as date) + 6 as period, {aggs} from e group by 1),
s as (select cast(w as date) as period
      from range(cast((select min(period) from g) as timestamp),
                 cast((select max(period) from g) as timestamp) + interval 1 day,
                 interval 7 day) t(w))
select s.period, {outs} from s left join g using (period)
"""


def _resample_day(spark, d):
    ev = _events_gap(spark, d)
    return rounded(TS.resample(ev, "ts", ["value"], "D"))


RESAMPLE_DAY_SQL = f"""
with e as ({EVENTS_GAP_SQL}),
g as (select cast(ts as date) as period, avg(value) as v from e group by 1),
s as (select cast(x as date) as period
      from range(cast((select min(period) from g) as timestamp),
                 cast((select max(period) from g) as timestamp) + interval 1 day, interval 1 day) t(x))
select s.period, round(g.v, 6) as value from s left join g using (period)
"""


def _trend(spark, d):
    series = TS.resample(_events_gap(spark, d), "ts", ["value", "user_id"], "D")
    return rounded(TS.trend(series, ["value", "user_id"]))


def trend_sql(metrics) -> str:
    series = f"""
with e as ({EVENTS_GAP_SQL}),
g as (select cast(ts as date) as period, {", ".join(f"avg({m}) as {m}" for m in metrics)} from e group by 1)"""
    parts = []
    for i, m in enumerate(metrics):
        parts.append(f"""
select '{m}' as metric, cast({i} as integer) as ordinal, cast(count(*) as bigint) as points,
       round(regr_slope(v, x), 6) as slope, round(regr_intercept(v, x), 6) as intercept,
       round(case when stddev_samp(v) = 0 then 0.0 else corr(x, v) end, 6) as r,
       case when regr_slope(v, x) > 0 then 'increasing' else 'decreasing' end as direction,
       round(abs(case when stddev_samp(v) = 0 then 0.0 else corr(x, v) end), 6) as strength
from (select {m} as v, cast(row_number() over (order by period) - 1 as double) as x
      from g where {m} is not null)
having count(*) > 1""")
    return series + "\n" + "\nunion all\n".join(parts)


def _position(spark, d):
    series = TS.resample(_events_gap(spark, d), "ts", ["value"], "D")
    return rounded(W.position(series, "period", "value"))


POSITION_SQL = f"""
with e as ({EVENTS_GAP_SQL}),
g as (select cast(ts as date) as period, avg(value) as v from e group by 1)
select period, round(v, 6) as value, cast(row_number() over (order by period) - 1 as bigint) as position
from g where v is not null
"""


def _first_last(spark, d):
    series = TS.resample(_events_gap(spark, d), "ts", ["value", "user_id"], "D")
    return rounded(W.first_last(series, "period", ["value", "user_id"]))


FIRST_LAST_SQL = f"""
with e as ({EVENTS_GAP_SQL}),
g as (select cast(ts as date) as period, avg(value) as value, avg(user_id) as user_id from e group by 1)
select 'value' as metric, round(arg_min(value, period), 6) as first, round(arg_max(value, period), 6) as last
from g where value is not null
union all
select 'user_id', round(arg_min(user_id, period), 6), round(arg_max(user_id, period), 6)
from g where user_id is not null
"""


def _time_series(spark, d):
    out = TS.time_series(load(spark, d, "orders"), "o_orderdate", ["o_totalprice", "o_custkey"], "auto")
    return rounded(out["trend"])


def time_series_sql() -> str:
    return """
with g as (select make_date(year(o_orderdate), 12, 31) as period, avg(o_totalprice) as p,
                  avg(o_custkey) as c from orders where o_orderdate is not null group by 1)""" + "\nunion all\n".join(
        f"""
select '{m}' as metric, cast({i} as integer) as ordinal, cast(count(*) as bigint) as points,
       round(regr_slope(v, x), 6) as slope, round(regr_intercept(v, x), 6) as intercept,
       round(case when stddev_samp(v) = 0 then 0.0 else corr(x, v) end, 6) as r,
       case when regr_slope(v, x) > 0 then 'increasing' else 'decreasing' end as direction,
       round(abs(case when stddev_samp(v) = 0 then 0.0 else corr(x, v) end), 6) as strength
from (select {col} as v, cast(row_number() over (order by period) - 1 as double) as x from g where {col} is not null)
having count(*) > 1""" for i, (m, col) in enumerate([("o_totalprice", "p"), ("o_custkey", "c")]))


def _resample_day_all(spark, d):
    """Daily means over the whole events table."""
    return rounded(TS.resample(load(spark, d, "events"), "ts", ["value", "user_id"], "D"))


RESAMPLE_DAY_ALL_SQL = """
with g as (select cast(ts as date) as period, avg(value) as value, avg(user_id) as user_id
           from events where ts is not null group by 1),
s as (select cast(x as date) as period
      from range(cast((select min(period) from g) as timestamp),
                 cast((select max(period) from g) as timestamp) + interval 1 day, interval 1 day) t(x))
select s.period, round(g.value, 6) as value, round(g.user_id, 6) as user_id from s left join g using (period)
"""


def _trend_all(spark, d):
    out = TS.time_series(load(spark, d, "events"), "ts", ["value", "user_id"], "auto")
    return rounded(out["trend"])


def trend_all_sql() -> str:
    head = """
with g as (select cast(date_trunc('week', ts) as date) + 6 as period, avg(value) as value,
                  avg(user_id) as user_id from events where ts is not null group by 1)"""
    parts = []
    for i, m in enumerate(["value", "user_id"]):
        parts.append(f"""
select '{m}' as metric, cast({i} as integer) as ordinal, cast(count(*) as bigint) as points,
       round(regr_slope(v, x), 6) as slope, round(regr_intercept(v, x), 6) as intercept,
       round(case when stddev_samp(v) = 0 then 0.0 else corr(x, v) end, 6) as r,
       case when regr_slope(v, x) > 0 then 'increasing' else 'decreasing' end as direction,
       round(abs(case when stddev_samp(v) = 0 then 0.0 else corr(x, v) end), 6) as strength
from (select {m} as v, cast(row_number() over (order by period) - 1 as double) as x
      from g where {m} is not null)
having count(*) > 1""")
    return head + "\n" + "\nunion all\n".join(parts)


def _series_line(spark, d):
    series = TS.resample(_events_gap(spark, d), "ts", ["value"], "W")
    return rounded(SE.series_line(series, "period", ["value"]))


SERIES_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _time_series_metrics(spark, d):
    """The resampled series itself, with more metrics than a suggestion names."""
    return rounded(TS.time_series(load(spark, d, "lineitem"), "l_shipdate", SERIES_METRICS, "M")["data"])


TIME_SERIES_METRICS_SQL = f"""
with g as (select last_day(l_shipdate) as period, {", ".join(f"avg({m}) as {m}" for m in SERIES_METRICS)}
           from lineitem where l_shipdate is not null group by 1),
s as (select last_day(cast(m as date)) as period
      from range(date_trunc('month', (select min(period) from g)),
                 date_trunc('month', (select max(period) from g)) + interval 1 month, interval 1 month) t(m))
select s.period, {", ".join(f"round(g.{m}, 6) as {m}" for m in SERIES_METRICS)} from s left join g using (period)
"""


QUERIES = [
    Query("auto_frequency", _auto_freq_orders, auto_freq_sql("orders", "o_orderdate")),
    Query("auto_frequency_events", _auto_freq_events, auto_freq_sql("events", "ts")),
    Query("resample", _resample_year, RESAMPLE_YEAR_SQL),
    Query("resample_month", _resample_month, RESAMPLE_MONTH_SQL),
    Query("resample_week", _resample_week, week_sql(["value", "user_id"])),
    Query("resample_day", _resample_day, RESAMPLE_DAY_SQL),
    Query("trend", _trend, trend_sql(["value", "user_id"])),
    Query("window_position", _position, POSITION_SQL),
    Query("window_first_last", _first_last, FIRST_LAST_SQL),
    Query("time_series", _time_series, time_series_sql()),
    Query("time_series_metrics", _time_series_metrics, TIME_SERIES_METRICS_SQL),
    Query("series_line", _series_line, week_sql(["value"])),
    Query("resample_day_all", _resample_day_all, RESAMPLE_DAY_ALL_SQL),
    Query("trend_all", _trend_all, trend_all_sql()),
]
