"""Correlation of many columns by blocked sums."""

import numpy as np
import pandas as pd
import pytest

from tabsight.operators import correlation as C


def frame(rows=300, cols=150, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 8))
    x = base @ rng.normal(size=(8, cols)) + rng.normal(size=(rows, cols)) + 1e6 * rng.integers(0, 3, cols)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 5] = 0.1                    # constant, its mean rounds
    x[:, 6] = np.nan                 # never present
    x[:, 7] = np.where(np.arange(rows) == 3, 1.0, np.nan)  # once
    return pd.DataFrame(x, columns=[f"c.{i}" for i in range(cols)])


def as_matrix(out, size):
    r, n = np.full((size, size), np.nan), np.zeros((size, size))
    rows = out.collect()
    assert len(rows) == size * size
    for x in rows:
        r[x.x_ordinal, x.y_ordinal] = np.nan if x.corr is None else x.corr
        n[x.x_ordinal, x.y_ordinal] = x.n
    return r, n


@pytest.mark.parametrize("panel", [512, 70])
def test_equals_pandas(spark, panel):
    pdf = frame()
    df = spark.createDataFrame(pdf).repartition(5)
    r, n = as_matrix(C.blocked_correlation(df, pdf.columns, panel), pdf.shape[1])
    assert np.allclose(r, pdf.corr().to_numpy(), atol=1e-9, equal_nan=True)
    seen = pdf.notna().to_numpy().astype(int)
    assert (n == seen.T @ seen).all()


def test_same_as_the_generated_aggregate(spark):
    pdf = frame(cols=12)
    df = spark.createDataFrame(pdf).repartition(3)
    one, two = C.correlation(df), C.correlation(df, pairs_per_pass=5)
    assert one.columns == two.columns and [f.dataType for f in one.schema] == [f.dataType for f in two.schema]
    (a, n), (b, m) = as_matrix(one, 12), as_matrix(two, 12)
    assert np.allclose(a, b, atol=1e-9, equal_nan=True) and (n == m).all()
    assert {x.col_x for x in two.collect()} == set(pdf.columns)


def test_infinity_touches_its_own_pairs_only(spark):
    pdf = frame(cols=9).iloc[:, :5]
    pdf.iloc[4, 0] = np.inf
    pdf.iloc[4, 1] = np.nan          # the infinite row is no row of this pair
    pdf.iloc[4, 2] = 1.0
    r, _ = as_matrix(C.blocked_correlation(spark.createDataFrame(pdf), pdf.columns), 5)
    assert np.isnan(r[0, 2]) and np.isnan(r[0, 0])
    assert np.isclose(r[0, 1], pdf.iloc[np.arange(len(pdf)) != 4, :2].corr().iloc[0, 1])
    assert np.isclose(r[2, 3], pdf.corr().iloc[2, 3])


def test_empty_table(spark):
    df = spark.createDataFrame(frame(cols=20).head(1)).where("false")
    r, n = as_matrix(C.correlation(df), 20)
    assert np.isnan(r).all() and not n.any()


def test_one_scan(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.createDataFrame(frame(rows=20).rename(columns=lambda c: c.replace(".", "_"))).write.parquet(path)
    plan = C.correlation(spark.read.parquet(path))._jdf.queryExecution().simpleString()
    assert plan.count("FileScan") == 1
