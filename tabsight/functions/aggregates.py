"""Aggregate expressions with pandas semantics that Spark lacks directly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_missing(missing: Column) -> Column:
    """Number of rows where the predicate holds, as bigint."""
    return F.count_if(missing).cast("bigint")


def sample_skewness(col: Column) -> Column:
    """Adjusted Fisher-Pearson skewness (pandas ``Series.skew``).

    Spark's ``skewness`` is the population g1; the sample statistic is
    ``g1 * sqrt(n (n - 1)) / (n - 2)``.  Fewer than three values -> NULL,
    a constant column -> 0.0.
    """
    n = F.count(col)
    g1 = F.skewness(col)
    adjusted = F.try_divide(g1 * F.sqrt(n * (n - F.lit(1))), n - F.lit(2))
    return (F.when(n < 3, F.lit(None).cast("double"))
             .when(F.min(col) == F.max(col), F.lit(0.0))
             .otherwise(adjusted))


def pairwise_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both values are present.

    Equal to ``corr`` but NULL (not an ANSI error) for a constant column,
    a single pair, or no pair at all.
    """
    both = a.isNotNull() & b.isNotNull()
    xa, xb = F.when(both, a), F.when(both, b)
    # deviations of a constant column are not zero when its partial means round
    varies = (F.min(xa) < F.max(xa)) & (F.min(xb) < F.max(xb))
    return F.when(varies, F.try_divide(F.covar_samp(a, b), F.stddev_samp(xa) * F.stddev_samp(xb)))
