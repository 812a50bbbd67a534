"""Grouped aggregations (reference section: grouped aggregations).

Every grouped operator aggregates with algebraic aggregates (count, sum,
avg, min, max), so Spark combines map-side and a hot key arrives at its
reducer as one partial row per map task, never as a third of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..functions.scalars import ref

from ..functions.scalars import nan_to_null, quoted
from .ordering import running_total


def _value(df: DataFrame, name: str):
    return nan_to_null(df, name)


def _all_present(cols: Sequence[str]):
    cond = F.lit(True)
    for c in cols:
        cond = cond & ref(c).isNotNull()
    return cond


def top_categories(df: DataFrame, dim: str, n: int = 10) -> DataFrame:
    """Frequency per category, missing excluded, most frequent first.

    (``dim``, count); ties are broken by the category value.
    """
    counts = df.where(ref(dim).isNotNull()).groupBy(ref(dim)).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(ref(dim))).limit(n)


def filter_top_categories(df: DataFrame, dim: str, n: int = 10) -> DataFrame:
    """The rows whose category is among the ``n`` most frequent ones.  The list
    holds ``n`` keys, which bounds the broadcast."""
    top = top_categories(df, dim, n).select(ref(dim).alias("_top"))
    return df.join(F.broadcast(top), ref(dim) == F.col("_top"), "left_semi")


def breakdown(df: DataFrame, dim: str, metrics: Sequence[str], top: int = 10) -> DataFrame:
    """Mean of each metric for the ``top`` most frequent categories.

    One scan and one shuffle: the counts and the metric sums are computed in
    the same grouped aggregate, then the top categories are picked from that
    grouped result (a distributed top-k), so no semi-join and no second scan
    is needed.
    """
    grouped = df.where(ref(dim).isNotNull()).groupBy(ref(dim)).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(_value(df, m)).alias(m) for m in metrics])
    top_rows = grouped.orderBy(F.desc("_n"), F.asc(ref(dim))).limit(top)
    return top_rows.select(ref(dim), *[ref(m) for m in metrics]).orderBy(ref(dim))


def extremes(grouped: DataFrame, dim: str, metrics: Sequence[str]) -> DataFrame:
    """Per metric the category with the highest and the lowest value.

    (metric, highest, highest_value, lowest, lowest_value); ties go to the
    smallest category.  ``min`` over structs merges partially, so it scales
    with the number of categories.
    """
    entries = []
    for i, m in enumerate(metrics):
        v = ref(m)
        hi = F.min(F.when(v.isNotNull(), F.struct((-v).alias("k"), ref(dim).alias("d"), v.alias("v"))))
        lo = F.min(F.when(v.isNotNull(), F.struct(v.alias("k"), ref(dim).alias("d"), v.alias("v"))))
        entries.append((m, i, hi.alias(f"hi{i}"), lo.alias(f"lo{i}")))
    agg = grouped.agg(*[e[2] for e in entries], *[e[3] for e in entries])
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(i).alias("ordinal"),
                     F.col(f"hi{i}.d").cast("string").alias("highest"),
                     F.col(f"hi{i}.v").alias("highest_value"),
                     F.col(f"lo{i}.d").cast("string").alias("lowest"),
                     F.col(f"lo{i}.v").alias("lowest_value"))
            for m, i, _, _ in entries]
    return agg.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


# Aggregate names accepted by the grouping analysis.
AGGREGATES = ("mean", "sum", "min", "max", "count", "median", "std", "var", "nunique", "size")


def _agg_expr(df: DataFrame, agg: str, m: str):
    v = _value(df, m)
    if agg == "mean":
        return F.avg(ref(v))
    if agg == "sum":
        return F.sum(ref(v))
    if agg == "min":
        return F.min(ref(v))
    if agg == "max":
        return F.max(ref(v))
    if agg == "count":
        return F.count(ref(v))
    if agg == "size":
        return F.count(F.lit(1))
    if agg == "std":
        return F.stddev_samp(ref(v))
    if agg == "var":
        return F.var_samp(ref(v))
    if agg == "nunique":
        return F.count_distinct(ref(v))
    raise ValueError(f"unknown aggregation {agg!r}; expected one of {AGGREGATES}")


def group_aggregate(df: DataFrame, dims: Sequence[str], metrics: Sequence[str],
                    agg: str = "mean") -> DataFrame:
    """Aggregate metrics by dimensions; rows with a missing key are dropped."""
    dims = list(dims)
    keyed = df.where(_all_present(dims))
    if agg == "median":
        return _grouped_median(keyed, dims, metrics)
    return keyed.groupBy(*[ref(d) for d in dims]).agg(*[_agg_expr(df, agg, m).alias(m) for m in metrics])


def _grouped_median(df: DataFrame, dims: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Exact median per group without holding a group's values in one task.

    Values are histogrammed per (group, metric, value); a distributed running
    count per (group, metric) then locates the middle ranks.
    """
    vals = df.select(*[ref(d) for d in dims], *[_value(df, m).cast("double").alias(m) for m in metrics])
    long = vals.unpivot([ref(d) for d in dims], [ref(m) for m in metrics], "_metric", "_v").where(F.col("_v").isNotNull())
    keys = list(dims) + ["_metric"]
    hist = long.groupBy(*[ref(k) for k in keys], "_v").agg(F.count(F.lit(1)).alias("_cnt"))
    ranked, totals = running_total(hist, ["_v"], "_cnt", "_cum", group_cols=keys,
                                   broadcast_offsets=False)
    targets = (totals.withColumn("_lo", F.floor((F.col("_cum") - 1) / 2))
               .withColumn("_hi", F.ceil((F.col("_cum") - 1) / 2))
               .select(*[ref(k) for k in keys], "_lo", "_hi"))
    start = F.col("r._cum") - F.col("r._cnt")
    covers = lambda rank: (start <= F.col(rank)) & (F.col(rank) < F.col("r._cum"))
    cond = [F.col(f"r.{quoted(k)}").eqNullSafe(F.col(f"t.{quoted(k)}")) for k in keys]
    hits = ranked.alias("r").join(targets.alias("t"), cond, "inner").where(
        covers("t._lo") | covers("t._hi"))
    med = hits.groupBy(*[F.col(f"t.{quoted(k)}").alias(k) for k in keys]).agg(
        ((F.max(F.when(covers("t._lo"), F.col("r._v")))
          + F.max(F.when(covers("t._hi"), F.col("r._v")))) / 2).alias("_med"))
    return med.groupBy(*[ref(d) for d in dims]).pivot("_metric", list(metrics)).agg(F.first("_med"))


def pivot_aggregate(df: DataFrame, dim1: str, dim2: str, metric: str,
                    agg: str = "mean") -> DataFrame:
    """dim1 x dim2 of one metric, long form: (dim1, dim2, value).

    The long form scales with the number of cells; ``pivot_wide`` turns it
    into the matrix when dim2 has few values.
    """
    keyed = df.where(ref(dim1).isNotNull() & ref(dim2).isNotNull())
    if agg == "median":
        g = _grouped_median(keyed, [dim1, dim2], [metric]).withColumnRenamed(metric, "value")
    else:
        g = keyed.groupBy(ref(dim1), ref(dim2)).agg(_agg_expr(df, agg, metric).alias("value"))
    return g


def pivot_wide(long: DataFrame, dim1: str, dim2: str, max_values: int | None = None) -> DataFrame:
    """Matrix view of ``pivot_aggregate``: one column per dim2 value.

    The dim2 values become column names, so the schema holds them all; with
    ``max_values`` set, more values raise (nothing is dropped).
    """
    from .prepare import categories
    values = categories(long.where(ref(dim2).isNotNull()), dim2, max_values)
    return long.groupBy(ref(dim1)).pivot(quoted(dim2), values).agg(F.first("value"))


def pareto(df: DataFrame, dim: str, metric: str, scale: int | None = None) -> DataFrame:
    """Sum by dimension, largest first, with running total and running share.

    (dim, metric, rank, cumulative, cumulative_pct).  The running total is
    distributed (``running_total``): the grouped table is range-partitioned
    on (metric desc, dim), so even billions of categories never meet in one
    task.  Ties in the metric are ordered by the category.

    With ``scale`` (decimal places of the metric, e.g. 2 for money) the sums
    are taken in integer units of 10**-scale, so they are exact and do not
    depend on the order of addition.
    """
    v = _value(df, metric)
    if scale is not None:
        v = F.round(v * F.lit(10 ** scale)).cast("bigint")
    grouped = df.where(ref(dim).isNotNull()).groupBy(ref(dim)).agg(
        F.coalesce(F.sum(ref(v)), F.lit(0)).alias("_units"))
    if scale is None:
        grouped = grouped.withColumn("_units", F.col("_units").cast("double"))
    ones = grouped.withColumn("_one", F.lit(1).cast("bigint"))
    order = [F.desc("_units"), F.asc(ref(dim))]
    with_cum, totals = running_total(ones, order, ["_one", "_units"], ["rank", "_cum"])
    total = totals.first()
    grand = total["_cum"] if total is not None else None
    pct = (F.try_divide(F.col("_cum").cast("double") * 100.0, F.lit(float(grand))) if grand
           else F.lit(None).cast("double"))
    unit = float(10 ** scale) if scale is not None else 1.0
    return with_cum.select(ref(dim), (F.col("_units").cast("double") / F.lit(unit)).alias(metric), "rank",
                           (F.col("_cum").cast("double") / F.lit(unit)).alias("cumulative"),
                           pct.alias("cumulative_pct"))


def pareto_summary(p: DataFrame, pct: float = 80.0) -> DataFrame:
    """Items whose cumulative share is <= ``pct`` and the number of items."""
    return p.agg(F.count_if(F.col("cumulative_pct") <= pct).cast("bigint").alias("items_within"),
                 F.count(F.lit(1)).alias("total_items"))


def per_metric(metrics: Sequence[str], one) -> DataFrame:
    """``one(metric)`` of every metric in long form, with a ``metric`` column."""
    out = None
    for m in metrics:
        part = one(m).withColumn("metric", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


def pivot_metrics(df: DataFrame, dim1: str, dim2: str, metrics: Sequence[str], agg: str = "mean") -> DataFrame:
    """(dim1, dim2, metric, value): every metric by two dimensions.  One
    grouped aggregate; the metrics become rows afterwards."""
    wide = group_aggregate(df, [dim1, dim2], metrics, agg)
    return wide.select(ref(dim1), ref(dim2), *[ref(m).cast("double").alias(m) for m in metrics]) \
        .unpivot([ref(dim1), ref(dim2)], [ref(m) for m in metrics], "metric", "value")


def comparison_metrics(df: DataFrame, dim: str, metrics: Sequence[str]) -> DataFrame:
    """(dim, metric, mean, count, sum) of every metric, from one grouped aggregate."""
    aggs = []
    for i, m in enumerate(metrics):
        v = _value(df, m)
        aggs += [F.avg(v).alias(f"a{i}"), F.count(v).alias(f"n{i}"), F.sum(v).cast("double").alias(f"s{i}")]
    wide = df.where(ref(dim).isNotNull()).groupBy(ref(dim)).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a{i}").alias("mean"), F.col(f"n{i}").alias("count"),
                              F.col(f"s{i}").alias("sum")) for i, m in enumerate(metrics)])
    return wide.select(ref(dim), F.explode(rows).alias("_e")).select(ref(dim), "_e.*")


def comparison(df: DataFrame, dim: str, metric: str) -> DataFrame:
    """Compare a metric across all categories: mean, count and sum."""
    return df.where(ref(dim).isNotNull()).groupBy(ref(dim)).agg(
        F.avg(_value(df, metric)).alias("mean"),
        F.count(_value(df, metric)).alias("count"),
        F.sum(_value(df, metric)).alias("sum"))
