"""Running totals, shares, positions and ordered picks (window section).

``cumsum`` and ``pct_of_total`` use the distributed running total; the
position of a period in a resampled series uses a plain window because the
series holds one row per calendar period (bounded by the time span over the
frequency), never raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from ..functions.scalars import ref

from .ordering import running_total


def cumsum(df: DataFrame, order: Sequence[Column | str], metric: str,
           out: str = "cumulative") -> DataFrame:
    """Running sum of ``metric`` in ``order`` (distributed prefix sum)."""
    rows, _ = running_total(df, order, metric, out)
    return rows


def pct_of_total(df: DataFrame, order: Sequence[Column | str], metric: str,
                 out: str = "cumulative_pct") -> DataFrame:
    """Running sum divided by the grand total, times 100."""
    rows, totals = running_total(df, order, metric, "_cum")
    total = totals.first()
    grand = total["_cum"] if total is not None else None
    pct = F.try_divide(F.col("_cum") * 100.0, F.lit(grand)) if grand else F.lit(None).cast("double")
    return rows.withColumn(out, pct).drop("_cum")


def position(series: DataFrame, order_by: str, metric: str, out: str = "position") -> DataFrame:
    """0-based position of each non-missing value along ``order_by``.

    Gaps are compressed: it is an ordinal, not a calendar distance.
    ``series`` is a resampled (one row per period) table.
    """
    w = Window.orderBy(ref(order_by))
    return (series.where(ref(metric).isNotNull())
            .withColumn(out, (F.row_number().over(w) - 1).cast("bigint")))


def first_last(df: DataFrame, order_by: str, metrics: Sequence[str]) -> DataFrame:
    """First and last non-missing value of each metric along ``order_by``.

    (metric, first, last); ``min_by`` / ``max_by`` merge partially.
    """
    entries = []
    for i, m in enumerate(metrics):
        present = ref(m).isNotNull()
        entries.append(F.struct(
            F.lit(m).alias("metric"),
            F.min_by(ref(m), F.when(present, ref(order_by))).alias("first"),
            F.max_by(ref(m), F.when(present, ref(order_by))).alias("last")))
    return df.agg(F.array(*entries).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def sort_desc(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """Rows by metric, largest first; ``tie`` makes the order total."""
    return df.orderBy(F.desc(ref(metric)), F.asc(ref(tie)))


def top_n(df: DataFrame, metric: str, tie: str, n: int = 10) -> DataFrame:
    """The ``n`` largest rows by metric (distributed top-k)."""
    return df.orderBy(F.desc(ref(metric)), F.asc(ref(tie))).limit(n)
