"""Chart series: the data behind each chart kind, computed by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..functions.scalars import ref

from ..functions.scalars import nan_to_null
from . import grouped as G
from ..sources.sampling import sample_rows


def series_line(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    return df.where(ref(x).isNotNull()).select(ref(x), *[ref(y) for y in ys]).orderBy(ref(x))


def series_bar(df: DataFrame, x: str, ys: Sequence[str], agg: str = "sum",
               top: int | None = None) -> DataFrame:
    """One bar per category (aggregated; raw rows never reach the chart)."""
    g = G.group_aggregate(df, [x], ys, agg)
    if top:
        g = g.orderBy(F.desc(ref(ys[0])), F.asc(ref(x))).limit(top)
    return g


def series_scatter(df: DataFrame, x: str, y: str, n: int | None = None,
                   key: Sequence[str] | None = None) -> DataFrame:
    """(x, y) points with both present; at most ``n`` with a reproducible sample."""
    axes = [x] if x == y else [x, y]
    pts = df.select(*[ref(k) for k in (key or []) if k not in axes],
                    *[nan_to_null(df, a).alias(a) for a in axes]).where(ref(x).isNotNull() & ref(y).isNotNull())
    if n is not None and key:
        pts = sample_rows(pts, n, key)
    return pts.select(*[ref(a) for a in axes])


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x: slope, intercept, r2 and point count."""
    xv, yv = nan_to_null(df, x).cast("double"), nan_to_null(df, y).cast("double")
    return df.agg(F.regr_slope(ref(yv), xv).alias("slope"), F.regr_intercept(ref(yv), xv).alias("intercept"),
                  F.regr_r2(ref(yv), xv).alias("r2"), F.regr_count(ref(yv), xv).alias("n"))


def histogram(df: DataFrame, metric: str, bins: int = 20) -> DataFrame:
    """Equal-width bins on [min, max]: (bin, lower, upper, count, mean), empty
    bins kept; ``mean`` is the metric's mean (drawn over the bars).

    The maximum falls in the last bin; a constant column is one bin.
    """
    v = nan_to_null(df, metric).cast("double")
    row = df.agg(F.min(ref(v)).alias("lo"), F.max(ref(v)).alias("hi"), F.avg(ref(v)).alias("mean")).first()
    spark = df.sparkSession
    if row["lo"] is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count bigint, mean double")
    lo, hi = float(row["lo"]), float(row["hi"])
    width = (hi - lo) / bins if hi > lo else 0.0
    if hi > lo:
        b = F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)).cast("int") + 1, F.lit(bins))
    else:
        b = F.lit(1)
    counts = df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    n_bins = bins if hi > lo else 1
    spine = spark.range(1, n_bins + 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        F.lit(row["mean"]).cast("double").alias("mean"))


def series_heatmap(long: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Cells of a heatmap from a long table (correlation or pivot)."""
    return long.select(ref(x).cast("string").alias("x"), ref(y).cast("string").alias("y"),
                       ref(z).cast("double").alias("z"))


def series_pareto(df: DataFrame, dim: str, metric: str, n: int = 10,
                  scale: int | None = None) -> DataFrame:
    """Bars and cumulative share of the ``n`` largest categories."""
    return G.pareto(df, dim, metric, scale).where(F.col("rank") <= n)


def series_pie(df: DataFrame, names: str, values: str) -> DataFrame:
    """Share of ``values`` by ``names`` (the grand total is one fitted scalar)."""
    g = df.where(ref(names).isNotNull()).groupBy(ref(names)).agg(
        F.sum(nan_to_null(df, values)).cast("double").alias(values))
    total = g.agg(F.sum(ref(values)).alias("t")).first()["t"]
    pct = F.try_divide(ref(values) * 100.0, F.lit(total)) if total else F.lit(None).cast("double")
    return g.withColumn("pct", pct)
