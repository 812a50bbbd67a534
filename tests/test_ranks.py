"""Exact quantiles by rounds of counting, against pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.operators import ranks
from tabsight.operators import stats as S

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def columns_of_all_kinds(n=4000):
    rng = np.random.default_rng(7)
    return pd.DataFrame({
        "normal": rng.normal(0, 1, n), "negative": -rng.lognormal(0, 30, n), "tail": rng.pareto(0.2, n) * 1e-200,
        "few": rng.integers(-2, 3, n).astype(float), "one": np.full(n, 7.25),
        "near": 1.0 + rng.integers(0, 50, n) * 2.0 ** -52, "tiny": rng.integers(-40, 40, n) * 5e-324,
        "zeros": np.where(rng.random(n) < 0.5, 0.0, -0.0), "huge": rng.choice([-1e308, 1e308, 3.0, np.inf, -np.inf], n),
        "gaps": np.where(rng.random(n) < 0.4, np.nan, rng.random(n)), "none": np.full(n, np.nan),
        "hot": np.where(rng.random(n) < 0.34, 5.0, rng.normal(5, 1e-9, n))})


def quantile(values, p):
    """Interpolated as the library does; numpy subtracts from the other side
    of the interval, which differs in the last bit and at infinities."""
    x = np.sort(values[~np.isnan(values)])
    if not len(x):
        return None
    at = p * (len(x) - 1)
    low, high = float(x[math.floor(at)]), float(x[math.ceil(at)])
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("few, partitions", [(1 << 16, 1), (0, 3), (50, 16)])
def test_quantiles_of_every_distribution(spark, monkeypatch, few, partitions):
    monkeypatch.setattr(ranks, "FEW", few)  # 0: all rounds down to the last bits
    pdf = columns_of_all_kinds()
    df = spark.createDataFrame(pdf).repartition(partitions)
    got = {(r["column"], r["prob"]): r["value"] for r in S.quantiles(df, list(pdf.columns), PROBS).collect()}
    for c in pdf.columns:
        for p in PROBS:
            want = quantile(pdf[c].to_numpy(), p)
            if want is None:
                assert (c, p) not in got
            else:
                assert got[c, p] == want or (math.isnan(want) and math.isnan(got[c, p])), (c, p)
            if c in ("normal", "few", "gaps", "hot"):
                assert got[c, p] == pytest.approx(pdf[c].quantile(p), rel=1e-12)


def test_order_of_bits():
    values = np.array([-np.inf, -1e308, -1.5, -5e-324, 0.0, 5e-324, 1e-300, 1.5, 1e308, np.inf])
    bits = ranks.ordered_bits(values)
    assert (np.diff(bits) > 0).all() and ranks.ordered_bits(np.array([-0.0])) == ranks.ordered_bits(np.array([0.0]))
    assert [ranks.value_of(int(b)) for b in bits] == values.tolist()


def test_few_scans_and_no_shuffle_of_values(spark, monkeypatch):
    scans = []
    count = ranks._bins
    monkeypatch.setattr(ranks, "_bins", lambda values, *rest: scans.append(rest[0]) or count(values, *rest))
    df = spark.range(30000).select((F.col("id") * F.lit(0.37)).alias("x"), F.lit(3).alias("y"), F.col("id").alias("z"))
    S.quantiles(df, ["x", "y", "z"], [0.5]).collect()
    assert scans == [48, 0]  # bins, then the few values left
    bins = count(df.select(F.col("x").cast("double")), 48, 64, None)
    assert bins.count() < 300  # what is shuffled: bins, however many rows


def test_ints_decimals_and_empty_tables(spark):
    df = spark.sql("select cast(id as decimal(12,2)) / 4 as d, cast(id % 7 as int) as i from range(101)")
    got = {(r["column"], r["prob"]): r["value"] for r in S.quantiles(df, ["d", "i"], [0.5, 0.25]).collect()}
    assert got == {("d", 0.5): 12.5, ("d", 0.25): 6.25, ("i", 0.5): 3.0, ("i", 0.25): 1.0}
    assert S.quantiles(df.filter("false"), ["d", "i"], [0.5]).count() == 0
    assert S.describe(df.filter("false"), ["d"]).collect()[0]["q50"] is None
