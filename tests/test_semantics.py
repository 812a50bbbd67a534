"""pandas semantics the operators must reproduce (expected values by hand)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tabsight.functions.aggregates import sample_skewness
from tabsight.operators import grouped as G
from tabsight.operators import prepare as R
from tabsight.operators import stats as S
from tabsight.operators import timeseries as TS


def nums(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def test_quantiles_linear(spark):
    df = nums(spark, [1.0, 2.0, 3.0, 10.0])
    q = {r["prob"]: r["value"] for r in S.quantiles(df, ["x"], [0.25, 0.5]).collect()}
    assert q == {0.25: 1.75, 0.5: 2.5}
    rough = {r["prob"]: r["value"] for r in S.quantiles(df, ["x"], [0.25, 0.5], exact=False).collect()}
    assert rough == {0.25: 1.0, 0.5: 2.0}


def test_std_and_skewness(spark):
    df = nums(spark, [1.0, 2.0, 3.0, 10.0])
    row = df.agg(F.stddev_samp("x").alias("s"), sample_skewness(F.col("x")).alias("k")).first()
    assert math.isclose(row["s"], 4.08248290463863, rel_tol=1e-12)
    assert math.isclose(row["k"], 1.763632614803888, rel_tol=1e-12)
    const = nums(spark, [5.0, 5.0, 5.0]).agg(sample_skewness(F.col("x")).alias("k")).first()["k"]
    assert const == 0.0
    two = nums(spark, [1.0, 2.0]).agg(sample_skewness(F.col("x")).alias("k")).first()["k"]
    assert two is None


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert S.mode_scalars(df, ["c"]) == {"c": "a"}


def test_one_hot(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None)], "i int, c string")
    out = R.one_hot(df.withColumnRenamed("c", "p"), ["p"]).orderBy("i").collect()
    assert [r["p_a"] for r in out] == [False, True, False]
    assert [r["p_b"] for r in out] == [True, False, False]
    assert out[0].__fields__ == ["i", "p_a", "p_b"]


def test_label_codes(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None)], "i int, c string")
    out = R.label_encode(df, ["c"]).orderBy("i").collect()
    assert [r["c_encoded"] for r in out] == [1, 0, -1]
    assert [r["c"] for r in out] == ["b", "a", None]


def _ts_frame(spark):
    rows = [(dt.datetime(2024, 1, 1), 2.0), (dt.datetime(2024, 1, 7, 10), 1.0),
            (dt.datetime(2024, 1, 8), 3.0), (None, 4.0)]
    return spark.createDataFrame(rows, "t timestamp_ntz, v double")


def test_weekly_mean_sunday_labels(spark):
    out = {r["period"]: r["v"] for r in TS.resample(_ts_frame(spark), "t", ["v"], "W").collect()}
    assert out == {dt.date(2024, 1, 7): 1.5, dt.date(2024, 1, 14): 3.0}


def test_monthly_and_yearly_labels(spark):
    m = {r["period"]: r["v"] for r in TS.resample(_ts_frame(spark), "t", ["v"], "M").collect()}
    y = {r["period"]: r["v"] for r in TS.resample(_ts_frame(spark), "t", ["v"], "Y").collect()}
    assert m == {dt.date(2024, 1, 31): 2.0}
    assert y == {dt.date(2024, 12, 31): 2.0}


def test_daily_gap_is_kept(spark):
    rows = [(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 4), 2.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    out = sorted((r["period"], r["v"]) for r in TS.resample(df, "t", ["v"], "D").collect())
    assert [v for _, v in out] == [1.0, None, None, 2.0]


def test_auto_frequency_thresholds(spark):
    def freq(days):
        rows = [(dt.datetime(2020, 1, 1),), (dt.datetime(2020, 1, 1) + dt.timedelta(days=days),)]
        return TS.choose_frequency(spark.createDataFrame(rows, "t timestamp_ntz"), "t")
    assert [freq(d) for d in (21, 22, 90, 91, 730, 731)] == ["D", "W", "W", "M", "M", "Y"]


def test_duplicates_missing_equals_missing(spark):
    df = spark.createDataFrame([(None,), (None,), (1.0,)], "x double")
    assert S.duplicate_rows(df).first()["duplicates"] == 1


def test_numeric_text(spark):
    from tabsight.functions.scalars import is_numeric_text
    not_num = ["1d", "1_000", "1,000", "0x1A", "nan", ""]
    num = [" 1 ", "1e5", "Infinity", "-2.5", ".5"]
    df = spark.createDataFrame([(v,) for v in not_num + num], "s string")
    got = {r["s"]: r["n"] for r in df.select("s", is_numeric_text(F.col("s")).alias("n")).collect()}
    assert not any(got[v] for v in not_num)
    assert all(got[v] for v in num)


def test_trend_constant_series_has_zero_strength(spark):
    rows = [(dt.date(2024, 1, d), 5.0) for d in range(1, 5)]
    series = spark.createDataFrame(rows, "period date, v double")
    r = TS.trend(series, ["v"]).first()
    assert r["strength"] == 0.0 and r["direction"] == "decreasing"


def test_pareto_threshold_excludes_crossing_item(spark):
    rows = [("a", 50.0), ("b", 30.0), ("c", 20.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    p = G.pareto(df, "k", "v")
    got = {r["k"]: r["cumulative_pct"] for r in p.collect()}
    assert got == {"a": 50.0, "b": 80.0, "c": 100.0}
    s = G.pareto_summary(p).first()
    assert (s["items_within"], s["total_items"]) == (2, 3)


def test_breakdown_extremes_ties_go_to_smallest(spark):
    rows = [("x", 1.0), ("y", 1.0), ("z", 0.0)]
    g = spark.createDataFrame(rows, "d string, m double")
    e = G.extremes(g, "d", ["m"]).first()
    assert (e["highest"], e["lowest"]) == ("x", "z")


@pytest.mark.parametrize("strategy,expected", [("mean", 2.0), ("median", 2.0), ("constant", 9.0)])
def test_impute(spark, strategy, expected):
    df = nums(spark, [1.0, 2.0, 3.0, None])
    out = R.impute(df, ["x"], strategy, 9.0 if strategy == "constant" else None)
    assert sorted(r["x"] for r in out.collect()) == sorted([1.0, 2.0, 3.0, expected])


def test_constant_impute_rejects_text_for_numbers(spark):
    with pytest.raises(ValueError):
        R.impute(nums(spark, [1.0, None]), ["x"], "constant", "abc")


def test_standardize_constant_column(spark):
    df = nums(spark, [3.0, 3.0])
    assert [r["x"] for r in R.standardize(df, ["x"]).collect()] == [None, None]
    assert [r["x"] for r in R.standardize(df, ["x"], on_constant="keep").collect()] == [3.0, 3.0]


def test_encoders_treat_nan_as_missing(spark):
    df = spark.createDataFrame([(0, 2.0), (1, float("nan")), (2, 1.0), (3, None)], "i int, x double")
    lab = R.label_encode(df, ["x"]).orderBy("i").collect()
    assert [r["x_encoded"] for r in lab] == [1, -1, 0, -1]
    hot = R.one_hot(df, ["x"]).orderBy("i").collect()
    assert hot[0].__fields__ == ["i", "x_1.0", "x_2.0"]
    assert [(r["x_1.0"], r["x_2.0"]) for r in hot] == [(False, True), (False, False), (True, False),
                                                        (False, False)]


def test_duplicates_null_patterns_and_signed_zero(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (None, 1.0), (0.0, 2.0), (-0.0, 2.0),
                                (float("nan"), 3.0), (None, 3.0)], "a double, b double")
    r = S.duplicate_rows(df).first()
    assert (r["rows"], r["duplicates"]) == (7, 3)


def test_extra_suggestions_added_only_when_not_covered(spark):
    from tabsight.operators import profile as P
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "x double, s string")
    extra = [{"type": "missing_values", "method": "imputation", "columns": ["x"],
              "parameters": {"strategy": "median"}},
             {"type": "standardization", "columns": ["x"]}]
    steps = P.to_steps(P.suggest_preprocessing(P.profile(df), extra))
    kinds = [(s["type"], s["columns"][0]) for s in steps]
    assert kinds.count(("missing_values", "x")) == 1           # already covered: not added
    assert ("standardization", "x") == kinds[-1]               # new: appended last
    assert steps[0]["parameters"] == {"strategy": "mean"}       # the rule's own choice stays
