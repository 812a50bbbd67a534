"""Values at the borders: long lists, widening fills, times, ragged CSV,
extra suggestions, empty selections, fitted steps and streams."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabsight.functions import scalars as SC
from tabsight.operators import catalog as K
from tabsight.operators import grouped as G
from tabsight.operators import predicates as PR
from tabsight.operators import prepare as R
from tabsight.operators import profile as P
from tabsight.operators import stats as S
from tabsight.operators import timeseries as TS
from tabsight.plans.tables import load
from tabsight.sources import csv as CSV
from tabsight.sources import sampling as SMP
from tabsight.streaming.replay import read_prepared, replay_stream

from conftest import SF_SMALL


@pytest.mark.parametrize("n", [999, 1000, 1001, 1500])
@pytest.mark.parametrize("kind", ["double", "int", "string", "float", "decimal(10,2)"])
def test_membership_means_the_same_at_any_length(spark, n, kind):
    df = spark.range(0, 40).select(F.col("id").cast("int").cast(kind).alias("v"), "id")
    values = [2, 4.0, 6.5, "8", None] + list(range(100, 100 + n - 5))
    got = sorted(r["id"] for r in PR.apply_filters(df, [{"column": "v", "type": "multiselect", "value": values}]).collect())
    assert got == ([2, 8] if kind == "string" else [2, 4, 8])


def test_constant_fill_widens(spark):
    df = spark.createDataFrame([(1, 2), (2, None)], "k int, v int")
    assert R.fill_missing(df, {"v": 0.5}).orderBy("k").collect()[1]["v"] == 0.5
    assert dict(R.fill_missing(df, {"v": 0.5}).dtypes)["v"] == "double"
    assert dict(R.fill_missing(df, {"v": 7}).dtypes)["v"] == "int"
    wide = R.fill_missing(df, {"v": 2**40})
    assert dict(wide.dtypes)["v"] == "bigint" and wide.orderBy("k").collect()[1]["v"] == 2**40
    with pytest.raises(ValueError):
        R.fill_missing(df, {"v": "x"})


def test_wall_clock_in_a_daylight_saving_gap(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-11-03 01:30:00",), ("2024-02-30 00:00:00",)], "t string")
        got = [r[0] for r in df.select(SC.parse_datetime(F.col("t"))).collect()]
        assert got == [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30), None]
        day = spark.createDataFrame([("2024-03-10",)], "t string").select(SC.parse_datetime(F.col("t"))).first()[0]
        assert day == dt.datetime(2024, 3, 10)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


# Expected outcomes written by hand, not taken from the engine's own lists.
NUMBERS = {"1": True, " 1 ": True, "1e5": True, "Infinity": True, "-.5": True, "+3.": True, "1d": False,
           "1_000": False, "1,000": False, "0x1A": False, "": False, "abc": False, "1 2": False, "--1": False}
DATES = {"2024-01-31": dt.datetime(2024, 1, 31), "2024-01-31 10:11:12": dt.datetime(2024, 1, 31, 10, 11, 12),
         "2024-13-01": None, "not a date": None, "": None, "20240131x": None}


def test_number_and_date_texts_by_hand(spark):
    df = spark.createDataFrame([(k,) for k in [*NUMBERS, *DATES]], "t string")
    got = {r["t"]: r for r in df.select("t", SC.is_numeric_text(F.col("t")).alias("n"),
                                        SC.parse_datetime(F.col("t")).alias("d")).collect()}
    assert {k: got[k]["n"] for k in NUMBERS} == NUMBERS
    assert {k: got[k]["d"] for k in DATES} == DATES


def test_domain_words_by_hand(spark):
    tables = {"a": "revenue double, customer string", "b": "salary double, hire_date date",
              "c": "warehouse string, inventory int", "d": "zzz int"}
    cat = K.column_catalog(spark, {t: spark.createDataFrame([], s) for t, s in tables.items()})
    got = {r["table"]: r["domain"] for r in K.detect_domain(cat).collect()}
    assert got == {"a": "sales", "b": "hr", "c": "operations", "d": "unknown"}


def write(text):
    path = os.path.join(tempfile.mkdtemp(prefix="tabsight-csv-"), "t.csv")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_short_rows_are_padded_and_long_rows_fail(spark):
    got = CSV.read_csv(spark, write("a,b,c\n1,x,2\n3\n4,y\n")).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, "x", 2), (3, None, None), (4, "y", None)]
    with pytest.raises(Exception, match="more fields"):
        CSV.read_csv(spark, write("a,b\n1,2\n3,4,5\n")).collect()


def test_csv_keeps_fractions_of_seconds(spark):
    ev = load(spark, SF_SMALL, "events").select("event_id", "ts")
    path = os.path.join(tempfile.mkdtemp(prefix="tabsight-csv-"), "out")
    CSV.write_csv(ev, path)
    back = spark.read.option("header", True).csv(path).select(
        F.col("event_id").cast("bigint"), F.col("ts").cast("timestamp_ntz"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ev.collect()))
    assert any(r["ts"].microsecond for r in ev.collect())


def test_extra_suggestions_keep_their_parameters(spark):
    df = spark.createDataFrame([(1, 2, "a"), (None, 3, "b")], "x int, y int, s string")
    extra = [{"type": "missing_values", "method": "imputation", "columns": ["x", "y"],
              "parameters": {"strategy": "constant", "value": 0.5}},
             {"type": "normalization", "columns": ["y"], "parameters": {"on_constant": "keep"}},
             {"type": "missing_values", "method": "imputation", "columns": ["x"], "parameters": {"strategy": "median"}}]
    found = P.suggest_preprocessing(P.profile(df), extra)
    steps = P.to_steps(found)
    assert extra[0] in steps and extra[1] in steps and extra[2] not in steps
    seqs = [r["seq"] for r in found.collect()]
    assert len(seqs) == len(set(seqs))


def test_quality_missing_takes_a_table_as_a_table(spark):
    df = spark.createDataFrame([(5, 10, 0, "c", "text")], "missing int, rows int, ordinal int, column string, family string")
    assert P.quality_missing(df).count() == 0


def test_nothing_to_do_gives_empty_frames(spark):
    df = spark.createDataFrame([("a",)], "s string")
    assert S.kpi(df, ["s"]).count() == 0
    assert PR.filter_bounds(df, ["s"]).count() == 0
    assert PR.filter_options(df, ["nope"]).count() == 0
    assert [r["value"] for r in PR.filter_options(df.union(df.select(F.lit("A"))), ["s"]).collect()] == ["A", "a"]


def test_time_series_takes_all_metrics_and_explains_itself(spark):
    li = load(spark, SF_SMALL, "lineitem")
    metrics = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = TS.time_series(li, "l_shipdate", metrics)
    assert out["data"].columns == ["period", *metrics] and out["trend"].count() == 4
    out = TS.time_series(li, "l_quantity", metrics)
    assert out["data"] is None and "l_quantity" in out["message"]


def test_resample_reads_its_source_once(spark):
    li = load(spark, SF_SMALL, "lineitem")
    plan = TS.resample(li, "l_shipdate", ["l_tax"], "auto")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan  # everything follows from the daily sums


def test_no_hidden_limits(spark):
    li = load(spark, SF_SMALL, "lineitem")
    assert S.before_after_stats(li, li).count() == 8
    wide = spark.range(1500).select("id", F.concat(F.lit("v"), F.col("id")).alias("c"))
    assert len(R.one_hot(wide, ["c"]).columns) == 1501
    with pytest.raises(ValueError):
        R.one_hot(wide, ["c"], max_categories=1000)
    assert R.one_hot_long(wide, ["id"], ["c"]).count() == 1500
    both = K.run_analysis(li, {"type": "grouping", "metrics": ["l_quantity", "l_tax"],
                               "dimensions": ["l_returnflag", "l_linestatus"]})["data"]
    assert {r["metric"] for r in both.collect()} == {"l_quantity", "l_tax"}


def test_sample_orders_only_its_share(spark):
    df = spark.range(200_000)
    key = F.md5(F.col("id").cast("string"))
    want = sorted(r["id"] for r in df.orderBy(key).limit(50).collect())
    got = SMP.sample_rows(df, 50, ["id"])
    assert sorted(r["id"] for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # heaps of the tasks, then of the exchange; the sort sees what they keep
    assert SMP.sample_rows(df.limit(7), 50, ["id"]).count() == 7


def test_a_value_that_fills_a_third_of_the_table(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot" * 50).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("t"),
                                  F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    assert S.duplicate_rows(df).first()["duplicates"] == 999
    assert S.mode_scalars(df, ["t"], hash_texts=["t"]) == {"t": "hot" * 50}
    assert S.unique_counts(df, ["t"], hash_texts=["t"]).first()["n_unique"] == 2001
    hollow = df.withColumn("t", F.when(F.col("k") != 1, F.col("t")))
    coded = R.label_encode(hollow, ["t"])
    assert coded.where("t is null").select("t_encoded").distinct().collect()[0][0] == -1
    assert coded.count() == 3000 and coded.where("t is not null").select("t_encoded").distinct().count() == \
        hollow.where("t is not null").select("t").distinct().count()
    med = G.group_aggregate(df.withColumn("g", F.lit("one")), ["g"], ["k"], "median").first()["k"]
    assert med == df.approxQuantile("k", [0.5], 0)[0] or abs(med - df.selectExpr("median(k)").first()[0]) < 1e-9


STEPS = [{"type": "missing_values", "method": "imputation", "columns": ["x"], "parameters": {"strategy": "mean"}},
         {"type": "standardization", "columns": ["y"]},
         {"type": "categorical_encoding", "method": "one_hot", "columns": ["f"]},
         {"type": "categorical_encoding", "method": "label", "columns": ["g"]}]


def stream_data(spark):
    rows = [(i, None if i % 4 == 0 else float(i), float(i * i), "abc"[i // 10], "xyz"[i // 10]) for i in range(30)]
    return spark.createDataFrame(rows, "k int, x double, y double, f string, g string")


def test_stream_of_several_files_equals_the_batch(spark):
    base = tempfile.mkdtemp(prefix="tabsight-stream-")
    df = stream_data(spark)
    for f in "abc":
        df.where(F.col("f") == f).coalesce(1).write.mode("append").parquet(f"{base}/src")
    q = replay_stream(spark, f"{base}/src", df.schema, STEPS, f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1)
    q.awaitTermination()
    got = read_prepared(spark, f"{base}/out")
    want = R.apply_pipeline(df, STEPS)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_new_category_stops_the_stream(spark):
    base = tempfile.mkdtemp(prefix="tabsight-stream-")
    df = stream_data(spark)
    fitted = R.fit(df.where("f <> 'c'"), STEPS[2:3])
    df.coalesce(1).write.parquet(f"{base}/src")
    q = replay_stream(spark, f"{base}/src", df.schema, [], f"{base}/out", f"{base}/ckpt", fitted=fitted)
    with pytest.raises(Exception, match="new category"):
        q.awaitTermination()
    label = R.fit(df.where("f <> 'c'"), [{"type": "categorical_encoding", "method": "label", "columns": ["f"]}])
    with pytest.raises(Exception, match="new category"):
        R.transform(df, label).collect()
    loose = R.transform(df, label, strict=False)
    assert {r["f_encoded"] for r in loose.where("f = 'c'").collect()} == {-1}


def test_neighbouring_fits_share_one_aggregate(spark):
    df = stream_data(spark).withColumn("z", F.col("y") + 1)
    steps = [STEPS[0], STEPS[1], {"type": "normalization", "columns": ["z"]}]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fused", "fused fits")
    R.apply_pipeline(df, steps)
    jobs = len(tracker.getJobIdsForGroup("fused"))
    spark.sparkContext.setJobGroup("single", "one fit")
    R.apply_pipeline(df, steps[:1])
    assert jobs == len(tracker.getJobIdsForGroup("single"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
