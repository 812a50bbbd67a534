"""Operators against pandas itself (the reference computes with pandas) on the
smallest driver tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.operators import correlation as C
from tabsight.operators import grouped as G
from tabsight.operators import prepare as R
from tabsight.operators import stats as S
from tabsight.operators import timeseries as TS
from tabsight.plans.tables import lineitem_dirty, load

from conftest import SF_SMALL

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def li(spark):
    return lineitem_dirty(spark, SF_SMALL)


@pytest.fixture(scope="module")
def pdf(li):
    return li.toPandas()


def close(a, b, tol=1e-9):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def test_describe_matches_pandas(li, pdf):
    ours = {r["column"]: r for r in S.describe(li, NUMS).collect()}
    theirs = pdf[NUMS].describe()
    for c in NUMS:
        for name, key in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                          ("25%", "q25"), ("50%", "q50"), ("75%", "q75"), ("max", "max")):
            assert close(float(theirs.loc[name, c]), float(ours[c][key])), (c, name)


def test_skew_mode_missing_unique(li, pdf):
    dist = {r["column"]: r for r in S.distribution(li, NUMS).collect()}
    for c in NUMS:
        assert close(float(pdf[c].skew()), dist[c]["skew"])
        assert close(float(pdf[c].median()), dist[c]["median"])
    modes = S.mode_scalars(li, ["l_returnflag", "l_quantity", "l_discount"])
    for c, v in modes.items():
        assert pdf[c].mode()[0] == v
    miss = {r["column"]: r["missing"] for r in S.missing_counts(li).collect()}
    uniq = {r["column"]: r["n_unique"] for r in S.unique_counts(li).collect()}
    for c in pdf.columns:
        assert miss[c] == int(pdf[c].isna().sum())
        assert uniq[c] == int(pdf[c].nunique())


def test_correlation_matches_pandas(li, pdf):
    ours = {(r["col_x"], r["col_y"]): r["corr"] for r in C.correlation(li, NUMS).collect()}
    theirs = pdf[NUMS].corr()
    for a in NUMS:
        for b in NUMS:
            assert close(float(theirs.loc[a, b]), ours[(a, b)], 1e-9)


def test_duplicates_match_pandas(li, pdf):
    cols = ["l_returnflag", "l_linestatus", "l_quantity"]
    assert S.duplicate_rows(li.select(*cols)).first()["duplicates"] == int(pdf[cols].duplicated().sum())


def test_pareto_matches_pandas(spark):
    li = load(spark, SF_SMALL, "lineitem")
    p = li.select("l_partkey", "l_extendedprice").toPandas()
    g = p.groupby("l_partkey")["l_extendedprice"].sum().reset_index()
    g = g.sort_values(["l_extendedprice", "l_partkey"], ascending=[False, True])
    g["cumulative_pct"] = g["l_extendedprice"].cumsum() / g["l_extendedprice"].sum() * 100
    ours = {r["l_partkey"]: r["cumulative_pct"] for r in G.pareto(li, "l_partkey", "l_extendedprice").collect()}
    for k, v in zip(g["l_partkey"], g["cumulative_pct"]):
        assert close(v, ours[k], 1e-9)
    within = int((g["cumulative_pct"] <= 80).sum())
    s = G.pareto_summary(G.pareto(li, "l_partkey", "l_extendedprice")).first()
    assert (s["items_within"], s["total_items"]) == (within, len(g))


@pytest.mark.parametrize("freq,rule", [("Y", "YE"), ("M", "ME"), ("W", "W"), ("D", "D")])
def test_resample_labels_match_pandas(spark, freq, rule):
    ev = load(spark, SF_SMALL, "events").where("not (ts between '2024-01-08' and '2024-01-15')")
    p = ev.select("ts", "value").toPandas().set_index("ts")["value"].resample(rule).mean()
    ours = {r["period"]: r["value"] for r in TS.resample(ev, "ts", ["value"], freq).collect()}
    assert len(ours) == len(p)
    for ts, v in p.items():
        assert close(None if np.isnan(v) else float(v), ours[ts.date()])


def test_encoders_match_pandas(li, pdf):
    dummies = pd.get_dummies(pdf["l_returnflag"], prefix="l_returnflag")
    ours = R.one_hot(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), ["l_returnflag"])
    assert [c for c in ours.columns if c.startswith("l_returnflag_")] == list(dummies.columns)
    got = ours.groupBy(*dummies.columns).count().collect()
    want = dummies.value_counts()
    assert {tuple(r[:-1]): r["count"] for r in got} == {k: v for k, v in want.items()}
    codes = pdf["l_linenumber_text"].astype("category").cat.codes.value_counts().to_dict()
    ours = R.label_encode(li, ["l_linenumber_text"]).groupBy("l_linenumber_text_encoded").count().collect()
    assert {r[0]: r[1] for r in ours} == {int(k): int(v) for k, v in codes.items()}


def test_scaling_and_imputation_match_pandas(li, pdf):
    out = R.impute(li, ["l_discount"], "mean")
    out = R.standardize(out, ["l_quantity"])
    out = R.normalize(out, ["l_extendedprice"]).select("l_discount", "l_quantity", "l_extendedprice").toPandas()
    p = pdf.copy()
    p["l_discount"] = p["l_discount"].fillna(p["l_discount"].mean())
    p["l_quantity"] = (p["l_quantity"] - p["l_quantity"].mean()) / p["l_quantity"].std()
    lo, hi = p["l_extendedprice"].min(), p["l_extendedprice"].max()
    p["l_extendedprice"] = (p["l_extendedprice"] - lo) / (hi - lo)
    for c in ("l_discount", "l_quantity", "l_extendedprice"):
        assert np.allclose(np.sort(out[c].to_numpy()), np.sort(p[c].to_numpy()), rtol=1e-9, atol=1e-12)


def test_breakdown_matches_pandas(spark):
    part = load(spark, SF_SMALL, "part")
    p = part.toPandas()
    top = p["p_brand"].value_counts()
    top = top.sort_index().sort_values(ascending=False, kind="stable").head(10).index
    want = p[p["p_brand"].isin(top)].groupby("p_brand")[["p_retailprice", "p_size"]].mean()
    got = {r["p_brand"]: r for r in G.breakdown(part, "p_brand", ["p_retailprice", "p_size"]).collect()}
    assert set(got) == set(want.index)
    for b in want.index:
        assert close(float(want.loc[b, "p_retailprice"]), got[b]["p_retailprice"])
        assert close(float(want.loc[b, "p_size"]), got[b]["p_size"])


def test_trend_matches_least_squares(spark):
    ev = load(spark, SF_SMALL, "events").where("not (ts between '2024-01-08' and '2024-01-15')")
    series = TS.resample(ev, "ts", ["value"], "D")
    y = pd.Series({r["period"]: r["value"] for r in series.collect()}).sort_index().dropna()
    x = np.arange(len(y))
    slope, intercept = np.polyfit(x, y.to_numpy(), 1)
    r = np.corrcoef(x, y.to_numpy())[0, 1]
    got = TS.trend(series, ["value"]).first()
    assert close(slope, got["slope"], 1e-8) and close(intercept, got["intercept"], 1e-8)
    assert close(r, got["r"], 1e-9) and got["points"] == len(y)
    assert got["direction"] == ("increasing" if slope > 0 else "decreasing")


def test_outliers_match_pandas(spark):
    ev = load(spark, SF_SMALL, "events")
    p = ev.select("value", "user_id").toPandas()
    got = {r["column"]: r["outliers"] for r in S.iqr_outliers(ev, ["value", "user_id"]).collect()}
    for c in ("value", "user_id"):
        q1, q3 = p[c].quantile(0.25), p[c].quantile(0.75)
        iqr = q3 - q1
        want = int(((p[c] < q1 - 1.5 * iqr) | (p[c] > q3 + 1.5 * iqr)).sum())
        assert got[c] == want


def test_numeric_text_rule_matches_pandas(li, pdf):
    from tabsight.operators import profile as P
    flagged = {r["column"] for r in P.quality_numeric_text(li).collect()}
    texts = [c for c in pdf.columns if pdf[c].dtype == object]
    want = {c for c in texts if pd.to_numeric(pdf[c], errors="coerce").notna().sum() / len(pdf) > 0.5}
    assert flagged == want


def test_date_text_detection_matches_pandas(li, pdf):
    from tabsight.operators import profile as P
    found = {r["column"] for r in P.date_candidates(li).collect()}
    want = set()
    for c in [c for c in pdf.columns if pdf[c].dtype == object]:
        try:
            pd.to_datetime(pdf[c], errors="raise", format="mixed")
            want.add(c)
        except (ValueError, TypeError):
            pass
    assert found == want
