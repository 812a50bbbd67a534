"""User column names with dots and spaces are taken literally everywhere."""

import datetime as dt

import pytest

from tabsight.operators import catalog as K
from tabsight.operators import correlation as C
from tabsight.operators import grouped as G
from tabsight.operators import predicates as PR
from tabsight.operators import prepare as R
from tabsight.operators import profile as P
from tabsight.operators import series as SE
from tabsight.operators import stats as S
from tabsight.operators import timeseries as TS


@pytest.fixture(scope="module")
def odd(spark):
    rows = [("a", float(d), dt.datetime(2024, 1, d), "x", f"2024-01-0{d}") for d in range(1, 8)]
    rows.append(("b", None, None, None, None))
    return spark.createDataFrame(
        rows, "`cat.name` string, `price usd` double, `order.date` timestamp_ntz, `s.t` string, `d.text` string")


CASES = {
    "profile": lambda df, spark: P.profile(df),
    "quality": lambda df, spark: P.quality_issues(df),
    "pipeline": lambda df, spark: R.apply_pipeline(df, P.to_steps(P.suggest_preprocessing(P.profile(df)))),
    "describe": lambda df, spark: S.describe(df),
    "mode": lambda df, spark: S.mode_value(df),
    "dups": lambda df, spark: S.duplicate_rows(df),
    "pareto": lambda df, spark: G.pareto(df, "cat.name", "price usd"),
    "breakdown": lambda df, spark: G.breakdown(df, "cat.name", ["price usd"]),
    "median": lambda df, spark: G.group_aggregate(df, ["cat.name"], ["price usd"], "median"),
    "pivot": lambda df, spark: G.pivot_wide(G.pivot_aggregate(df, "cat.name", "s.t", "price usd"), "cat.name", "s.t"),
    "corr": lambda df, spark: C.correlation(df),
    "resample": lambda df, spark: TS.resample(df, "order.date", ["price usd"], "auto"),
    "time_text": lambda df, spark: TS.time_series(df, "d.text", ["price usd"])["trend"],
    "filters": lambda df, spark: PR.apply_filters(df, [{"column": "cat.name", "type": "select", "value": "a"}]),
    "label": lambda df, spark: R.label_encode(df, ["cat.name"]),
    "catalog": lambda df, spark: K.classify_columns(K.catalog_facts(spark, {"t": df})),
    "scatter": lambda df, spark: SE.series_scatter(df, "price usd", "price usd"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_operator_accepts_dotted_names(spark, odd, name):
    CASES[name](odd, spark).collect()


def test_values_with_dotted_names(spark, odd):
    p = {r["column"]: r for r in P.profile(odd).collect()}
    assert p["price usd"]["median"] == 4.0 and p["cat.name"]["n_unique"] == 2
    assert p["d.text"]["date_format"] == "yyyy-MM-dd"
    par = {r["cat.name"]: r["cumulative_pct"] for r in G.pareto(odd, "cat.name", "price usd").collect()}
    assert par == {"a": 100.0, "b": 100.0}
