"""Bounded aggregates, duplicate counts by digest and the fit planner."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tabsight.operators import bounded as B
from tabsight.operators import predicates as PR
from tabsight.operators import prepare as R
from tabsight.operators import stats as S
from tabsight.plans.q_prepare import STEPS
from tabsight.plans.tables import lineitem_dirty, load
from tabsight.sources import sampling as SMP

from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_smallest_distinct_over_many_tasks(spark):
    rows = [(f"v{i % 977:04d}", float(i % 3) if i % 7 else None, i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "a string, b double, c long").repartition(16)
    got = {}
    for r in B.smallest_distinct(df, ["a", "b", "c"], 5).collect():
        got.setdefault(r["column"], []).append(r["value"])
    assert sorted(got["a"]) == [f"v{i:04d}" for i in range(5)]
    assert sorted(got["b"]) == ["0.0", "1.0", "2.0"]
    assert sorted(got["c"]) == sorted(map(str, range(20_000)))[:5]
    assert plan(B.smallest_distinct(df, ["a", "b", "c"], 5)).count("Expand") == 0


def test_few_distinct_edges(spark):
    rows = [(None, float("nan"), "x" * 100_000 + str(i % 12)) for i in range(60)]
    df = spark.createDataFrame(rows, "gone string, nan double, long string")
    got = {r["column"]: (r["few"], r["n_unique"]) for r in B.few_distinct(df, df.columns, 10).collect()}
    assert got == {"gone": (True, 0), "nan": (True, 0), "long": (False, None)}
    assert {r["column"]: r["n_unique"] for r in B.few_distinct(df, ["long"], 13).collect()} == {"long": 12}
    assert {r["n_unique"] for r in B.few_distinct(df.limit(0), df.columns, 10).collect()} == {0}
    assert B.smallest_distinct(df, [], 3).count() == 0


def test_bounded_kinds_agree_with_counts(spark):
    li = load(spark, SF_SMALL, "lineitem")
    kinds = [{r["column"]: r["kind"] for r in PR.filter_kinds(li, li.columns, counts=c).collect()} for c in (True, False)]
    assert kinds[0] == kinds[1] and set(kinds[0].values()) == {"select", "multiselect"}


def test_sample_is_the_smallest_hashes_in_one_scan(spark):
    li = load(spark, SF_SMALL, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    got = SMP.sample_rows(li, 300, keys)
    want = li.withColumn("_k", SMP.sample_key(keys)).orderBy("_k").limit(300).drop("_k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert plan(SMP.sample_rows(li, 300, keys)).count("FileScan") == 1 and got.schema == li.schema


def test_sample_keeps_every_type_and_name(spark):
    row = (1, "a", None, [1.5, None], {"k": 2}, datetime.datetime(2024, 1, 1, 0, 0, 0, 7), b"\x00\xff")
    df = spark.createDataFrame([row] * 5, "id int, `a.b` string, `_key` string, arr array<double>, "
                                          "m map<string,int>, ts timestamp, raw binary")
    got = SMP.sample_rows(df, 3, ["id"])
    assert [tuple(r) for r in got.collect()] == [tuple(df.first())] * 3 and got.schema == df.schema
    assert SMP.sample_rows(df, 50, ["id"]).count() == 5 and SMP.sample_rows(df, 0, ["id"]).count() == 0
    odd = df.select("id", F.expr("interval 2 day").alias("i"))
    assert SMP.sample_rows(odd, 2, ["id"]).count() == 2


def test_duplicates_are_whole_rows(spark):
    rows = [("a", "bc", None, 0.0), ("ab", "c", None, -0.0), (None, "n;", 1, math.nan), ("n;", None, 1, None),
            ("1:a", "", None, None), ("1:", "a", None, None)]
    df = spark.createDataFrame(rows, "x string, y string, z int, f double")
    assert tuple(S.duplicate_rows(df).first()) == (6, 0)
    same = spark.createDataFrame([("a", 0.0), ("a", -0.0), (None, math.nan), (None, None)], "x string, f double")
    assert tuple(S.duplicate_rows(same).first()) == (4, 2)
    nested = spark.createDataFrame([([1.0, None], ("p", [""])), ([1.0, None], ("p", [""])), ([1.0], ("p", [])),
                                    (None, None), (None, (None, None))],
                                   "a array<double>, s struct<t:string,u:array<string>>")
    assert tuple(S.duplicate_rows(nested).first()) == (5, 1)
    p = plan(S.duplicate_rows(load(spark, SF_SMALL, "lineitem")))
    assert p.count("FileScan") == 1 and "Join" not in p


def test_hour_that_comes_twice_is_no_duplicate(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1730611800,), (1730615400,)], "s long").select(F.timestamp_seconds("s").alias("t"))
        assert S.duplicate_rows(df).first()["duplicates"] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_levels_follow_columns_and_dropped_rows():
    fill = {"type": "missing_values", "method": "imputation", "columns": ["a"]}
    scale = {"type": "standardization", "columns": ["a", "b"]}
    drop = {"type": "missing_values", "method": "drop_rows", "columns": ["c"]}
    hot = {"type": "categorical_encoding", "method": "one_hot", "columns": ["d"]}
    label = {"type": "categorical_encoding", "method": "label", "columns": ["e"]}
    names = list("abcde")
    assert R.fit_levels([fill, scale, hot, label], names) == [[0, 2, 3], [1]]
    assert R.fit_levels([fill, drop, hot], names) == [[0], [1], [2]]
    assert R.fit_levels([hot, {"type": "normalization", "columns": ["d_x"]}], names) == [[0], [1]]
    assert R.fit_levels([label, {"type": "normalization", "columns": ["E_encoded"]}], names) == [[0], [1]]
    assert R.fit_levels([], names) == [] and R.fit_levels([fill], []) == [[0]]


@pytest.mark.parametrize("extra", [[], [{"type": "missing_values", "method": "drop_rows", "columns": ["l_quantity"]}]])
def test_levels_give_what_one_step_after_the_other_gives(spark, extra):
    df = lineitem_dirty(spark, SF_SMALL)
    steps = STEPS[:3] + extra + STEPS[3:] + [{"type": "standardization", "columns": ["l_returnflag_encoded", "l_tax"]}]
    got = R.apply_pipeline(df, steps)
    want = df
    for step in steps:
        want = R.apply_step(want, step)
    assert got.columns == want.columns
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    for g, w in zip(got.orderBy(*key).collect(), want.orderBy(*key).collect(), strict=True):
        for x, y in zip(g, w):
            assert x == y or x == pytest.approx(y)
    assert len(R.fit_levels(STEPS, df.columns)) <= 3


def test_categories_of_several_columns_at_once(spark):
    df = spark.createDataFrame([("b", 2, None), ("a", None, None), ("b", 10, None)], "x string, y int, z string")
    assert R.category_lists(df, {"x": None, "y": 5, "z": None}) == {"x": ["a", "b"], "y": [2, 10], "z": []}
    with pytest.raises(ValueError, match="more than 1"):
        R.category_lists(df, {"x": 1})
