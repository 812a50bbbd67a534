"""Properties: scaling, encodings, histogram, running totals, partition independence."""

import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabsight.operators import grouped as G
from tabsight.operators import prepare as R
from tabsight.operators import series as SE
from tabsight.operators import stats as S
from tabsight.operators.ordering import running_total
from tabsight.plans.tables import load

from conftest import SF_SMALL


def test_standardized_mean_zero_std_one(spark):
    li = load(spark, SF_SMALL, "lineitem")
    out = R.standardize(li, ["l_quantity"]).agg(F.avg("l_quantity").alias("m"),
                                                F.stddev_samp("l_quantity").alias("s")).first()
    assert abs(out["m"]) < 1e-9 and abs(out["s"] - 1) < 1e-9


def test_normalized_in_unit_interval(spark):
    li = load(spark, SF_SMALL, "lineitem")
    out = R.normalize(li, ["l_extendedprice"]).agg(F.min("l_extendedprice").alias("lo"),
                                                   F.max("l_extendedprice").alias("hi")).first()
    assert out["lo"] == 0.0 and out["hi"] == 1.0


def test_one_hot_row_sums(spark):
    li = load(spark, SF_SMALL, "lineitem").select(
        "l_orderkey", F.when(F.col("l_orderkey") % 5 == 0, None).otherwise(F.col("l_returnflag"))
        .alias("f"))
    out = R.one_hot(li, ["f"])
    dummies = [c for c in out.columns if c.startswith("f_")]
    sums = out.select((sum(F.col(c).cast("int") for c in dummies)).alias("s"),
                      (F.col("l_orderkey") % 5 == 0).alias("masked")).distinct().collect()
    assert {(r["s"], r["masked"]) for r in sums} == {(1, False), (0, True)}


def test_label_codes_dense_and_ordered(spark):
    li = load(spark, SF_SMALL, "lineitem").select("l_partkey")
    codes, n = R.label_codes(li, "l_partkey")
    rows = sorted((r["value"], r["code"]) for r in codes.collect())
    assert [c for _, c in rows] == list(range(n))


def test_histogram_counts_sum_to_rows(spark):
    ev = load(spark, SF_SMALL, "events")
    h = SE.histogram(ev, "value", 20).collect()
    assert len(h) == 20
    assert sum(r["count"] for r in h) == ev.where(F.col("value").isNotNull()).count()


def test_pareto_last_share_is_100(spark):
    li = load(spark, SF_SMALL, "lineitem")
    p = G.pareto(li, "l_partkey", "l_extendedprice")
    last = p.orderBy(F.desc("rank")).first()
    assert abs(last["cumulative_pct"] - 100.0) < 1e-9


def test_running_total_matches_window(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("abc"), rnd.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, k long")
    got, totals = running_total(df, ["v", "k"], "v", "cum", group_cols=["g"], num_partitions=7)
    w = Window.partitionBy("g").orderBy("v", "k").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("cum", F.sum("v").over(w))
    a = sorted(tuple(r) for r in got.select("g", "k", "cum").collect())
    b = sorted(tuple(r) for r in want.select("g", "k", "cum").collect())
    assert a == b
    t = {r["g"]: r["cum"] for r in totals.collect()}
    assert t == {g: sum(v for gg, v, _ in rows if gg == g) for g in "abc"}


def test_quantiles_match_pandas(spark):
    rnd = random.Random(3)
    vals = [rnd.gauss(0, 1) for _ in range(1001)] + [None] * 5
    df = spark.createDataFrame([(v, v) for v in vals], "a double, b double")
    s = pd.Series([v for v in vals if v is not None])
    for p in (0.1, 0.25, 0.5, 0.9):
        exp = s.quantile(p)
        got = {(r["column"], r["prob"]): r["value"] for r in S.quantiles(df, ["a", "b"], [p]).collect()}
        assert abs(got["a", p] - exp) < 1e-12 and got["b", p] == got["a", p]


def test_independent_of_partitioning(spark):
    li = load(spark, SF_SMALL, "lineitem")
    a = sorted(tuple(r) for r in S.numeric_stats(li.repartition(1)).collect())
    b = sorted(tuple(r) for r in S.numeric_stats(li.repartition(13)).collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and abs(u - v) < 1e-9 * max(1, abs(u)))


def test_correlation_chunked_equals_single_pass(spark):
    from tabsight.operators.correlation import correlation
    li = load(spark, SF_SMALL, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    one = sorted(tuple(r) for r in correlation(li).collect())
    many = sorted(tuple(r) for r in correlation(li, pairs_per_pass=3).collect())
    assert len(one) == 16
    for a, b in zip(one, many, strict=True):  # sums in another order: alike but for rounding
        assert a[:4] + a[5:] == b[:4] + b[5:] and abs(a[4] - b[4]) < 1e-12 and max(abs(a[4]), abs(b[4])) <= 1


def test_per_column_passes_equal_single_pass(spark, monkeypatch):
    from tabsight.operators import profile as P
    li = load(spark, SF_SMALL, "lineitem")

    def snapshot():
        return sorted(tuple(r) for r in P.profile(li, samples=3).collect())

    one = snapshot()
    monkeypatch.setattr(S, "COLUMNS_PER_PASS", 3)
    many = snapshot()
    assert len(one) == len(li.columns) and one == many
    assert sorted(tuple(r) for r in S.missing_counts(li).collect()) == sorted(
        (c, i, li.count(), 0, 0.0) for i, c in enumerate(li.columns))


def test_samples_are_the_smallest_distinct_values(spark):
    docs = load(spark, SF_SMALL, "documents")
    got = {r["column"]: r["samples"] for r in S.column_samples(docs, ["text", "lang"], 10).collect()}
    for c in ("text", "lang"):
        values = sorted({r[0] for r in docs.select(c).collect() if r[0] is not None}, key=lambda v: v.encode())
        assert got[c] == values[:10]
    same = spark.createDataFrame([("p" * 80 + str(i % 30).zfill(2),) for i in range(200)] + [(None,)], "t string")
    got = S.column_samples(same, ["t"], 5).first()["samples"]
    assert got == ["p" * 80 + f"{i:02d}" for i in range(5)]


def test_text_distinct_counts_match_exact(spark):
    docs = load(spark, SF_SMALL, "documents")
    hashed = {r["column"]: r["n_unique"] for r in
              S.unique_counts(docs, ["text", "lang", "source"], hash_texts=["text", "lang", "source"]).collect()}
    plain = {r["column"]: r["n_unique"] for r in S.unique_counts(docs, ["text", "lang", "source"]).collect()}
    assert hashed == plain


def test_running_total_exact_beyond_float_precision(spark):
    big = 2 ** 53 + 1
    rows = [(i, big) for i in range(6)]
    df = spark.createDataFrame(rows, "k long, v long")
    got, totals = running_total(df, ["k"], "v", "cum", num_partitions=2)
    assert sorted(r["cum"] for r in got.collect()) == [big * (i + 1) for i in range(6)]
    assert totals.first()["cum"] == big * 6


def test_text_modes_match_plain(spark):
    docs = load(spark, SF_SMALL, "documents")
    cols = ["text", "lang", "source"]
    assert S.mode_scalars(docs, cols, hash_texts=cols) == S.mode_scalars(docs, cols)
    rows = [("b",), ("a",), ("b",), ("a",), (None,), ("c",)]
    df = spark.createDataFrame(rows, "t string")
    assert S.mode_scalars(df, ["t"], hash_texts=["t"]) == {"t": "a"}
    empty = spark.createDataFrame([(None,)], "t string")
    assert S.mode_scalars(empty, ["t"], hash_texts=["t"]) == {"t": None}


def test_sketch_profile_close_to_exact(spark):
    from tabsight.operators import profile as P
    li = load(spark, SF_SMALL, "lineitem")
    exact = {r["column"]: r for r in P.profile(li).collect()}
    approx = {r["column"]: r for r in P.profile(li, approx_distinct=True, exact=False).collect()}
    assert set(exact) == set(approx)
    for c, r in exact.items():
        assert abs(approx[c]["n_unique"] - r["n_unique"]) <= max(2, 0.1 * r["n_unique"])
        if r["median"] is not None:
            lo, hi = r["min"], r["max"]
            assert abs(approx[c]["median"] - r["median"]) <= 0.05 * (hi - lo) + 1e-9
        assert approx[c]["missing"] == r["missing"] and approx[c]["mean"] == r["mean"]
