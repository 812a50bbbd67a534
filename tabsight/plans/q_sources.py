"""Queries for CSV round trips, record output, samples and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import csv as CSV
from ..sources import records as REC
from ..sources import sampling as SMP
from .common import rounded
from .registry import Query
from .tables import load


def _scan_csv(spark, d):
    """orders written as CSV (with missing tokens) and read back with type inference."""
    orders = load(spark, d, "orders")
    masked = orders.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("NA")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice", "o_orderdate", "o_orderpriority",
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a"))
        .otherwise(F.col("o_totalprice").cast("string")).alias("price_text"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("True")).otherwise(F.lit("False")).alias("flag"),
        F.lit("-").alias("dash"))
    path = scratch_path(spark, "orders-csv")
    CSV.write_csv(masked, path)
    return rounded(CSV.read_csv(spark, path))


SCAN_CSV_SQL = """
select o_orderkey, o_custkey, case when o_orderkey % 9 = 0 then null else o_orderstatus end as o_orderstatus,
       round(o_totalprice, 6) as o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate,
       o_orderpriority,
       case when o_orderkey % 5 = 0 then null else round(o_totalprice, 6) end as price_text,
       o_orderkey % 3 = 0 as flag, '-' as dash
from orders
"""


def _sink_csv(spark, d):
    """events written as header CSV in parallel and read back as text."""
    ev = load(spark, d, "events")
    path = scratch_path(spark, "events-csv")
    CSV.write_csv(ev, path)
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return back.select(*[F.col(c).cast(t) for c, t in ev.dtypes])


def _scan_csv_events(spark, d):
    """events as CSV and back with inferred types: fractions of seconds, JSON
    text with quotes and commas."""
    path = scratch_path(spark, "events-scan-csv")
    CSV.write_csv(load(spark, d, "events"), path)
    back = CSV.read_csv(spark, path)
    return back.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _sink_records(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return REC.to_records(orders)


def _sample(spark, d):
    li = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ship"))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship"]
    return rounded(SMP.sample_rows(li, 5000, key)).drop("ship")


def _preview(spark, d):
    return rounded(SMP.preview(load(spark, d, "orders"), ["o_orderkey"], 10))


def _head_tail(spark, d):
    return rounded(SMP.head_tail(load(spark, d, "orders"), ["o_orderkey"], 10))


def _head_tail_small(spark, d):
    """A frame with at most 2 * limit rows comes back whole."""
    return SMP.head_tail(load(spark, d, "region"), ["r_regionkey"], 10)


QUERIES = [
    Query("scan_csv", _scan_csv, SCAN_CSV_SQL),
    Query("sink_csv", _sink_csv, """
select * from events"""),
    Query("scan_csv_events", _scan_csv_events, "select * from events"),
    Query("sink_records", _sink_records, """
select to_json(struct_pack(o_orderkey := o_orderkey, o_custkey := o_custkey, o_orderstatus := o_orderstatus,
                           o_orderpriority := o_orderpriority))::varchar as record from orders"""),
    Query("sample_rows", _sample, """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 6) as l_quantity from lineitem
order by md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'))) limit 5000"""),
    Query("preview_head", _preview, """
select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) as o_totalprice, o_orderdate, o_orderpriority
from orders order by o_orderkey limit 10"""),
    Query("preview_head_tail", _head_tail, """
select * from (select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) as o_totalprice, o_orderdate,
                      o_orderpriority from orders order by o_orderkey limit 10)
union
select * from (select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) as o_totalprice, o_orderdate,
                      o_orderpriority from orders order by o_orderkey desc limit 10)"""),
    Query("preview_head_tail_small", _head_tail_small, "select r_regionkey, r_name from region"),
]
