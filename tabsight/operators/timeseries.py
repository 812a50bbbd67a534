"""Calendar resampling, frequency choice and trend (time-series analysis)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from ..functions.scalars import ref

from ..functions.aggregates import pairwise_corr
from ..functions.scalars import (DATETIME, TEXT, family_of, floor_days, nan_to_null,
                                 parse_datetime, period_label)
from ..session import ensure_checkpoint_dir

# Span thresholds in days for the automatic frequency
# (more than 730 -> yearly, more than 90 -> monthly, more than 21 -> weekly,
# otherwise daily).
YEARLY_AFTER_DAYS = 365 * 2
MONTHLY_AFTER_DAYS = 90
WEEKLY_AFTER_DAYS = 21


def as_timestamp(df: DataFrame, time: str) -> DataFrame:
    """The time column as ``timestamp_ntz`` (text is parsed; failures -> NULL)."""
    fam = family_of(df.schema[time].dataType)
    if fam == DATETIME:
        return df.withColumn(time, ref(time).cast("timestamp_ntz"))
    if fam == TEXT:
        return df.withColumn(time, parse_datetime(ref(time)))
    raise ValueError(f"column {time!r} cannot be read as a time")


def frequency_expr(span_days) -> F.Column:
    return (F.when(span_days > YEARLY_AFTER_DAYS, "Y")
             .when(span_days > MONTHLY_AFTER_DAYS, "M")
             .when(span_days > WEEKLY_AFTER_DAYS, "W")
             .otherwise("D"))


def auto_frequency(df: DataFrame, time: str) -> DataFrame:
    """(min_ts, max_ts, span_days, frequency) -- one pass, one row."""
    ts = as_timestamp(df, time)
    span = ts.agg(F.min(ref(time)).alias("min_ts"), F.max(ref(time)).alias("max_ts"))
    days = floor_days(F.col("min_ts"), F.col("max_ts"))
    return span.select("min_ts", "max_ts", days.cast("bigint").alias("span_days"),
                       frequency_expr(days).alias("frequency"))


def choose_frequency(df: DataFrame, time: str, freq: str = "auto") -> str:
    if freq and freq.lower() != "auto":
        return freq.upper()
    row = auto_frequency(df, time).first()
    return row["frequency"] if row and row["frequency"] else "D"


def _spine(bounds: DataFrame, freq: str) -> DataFrame:
    """Every period label between the first and the last (inclusive)."""
    lo, hi = F.col("lo"), F.col("hi")
    if freq == "Y":
        labels = F.transform(F.sequence(F.year(ref(lo)), F.year(ref(hi))),
                             lambda y: F.make_date(y, F.lit(12), F.lit(31)))
    elif freq == "M":
        starts = F.sequence(F.trunc(lo, "MM"), F.trunc(hi, "MM"), F.expr("INTERVAL 1 MONTH"))
        labels = F.transform(starts, lambda d: F.last_day(d))
    elif freq == "W":
        labels = F.sequence(lo, hi, F.expr("INTERVAL 7 DAYS"))
    else:
        labels = F.sequence(lo, hi, F.expr("INTERVAL 1 DAY"))
    return bounds.where(lo.isNotNull()).select(F.explode(labels).alias("period"))


def _daily(ts: DataFrame, time: str, metrics: Sequence[str]) -> DataFrame:
    """Sum and count of each metric per day, with the first and last time.

    The only scan of the source: frequency, bounds and periods of every
    length follow from it.  One row a day, checkpointed.
    """
    ensure_checkpoint_dir(ts.sparkSession)
    labelled = ts.where(ref(time).isNotNull()).select(
        F.to_date(ref(time)).alias("_day"), ref(time).alias("_ts"),
        *[nan_to_null(ts, m).alias(f"_m{i}") for i, m in enumerate(metrics)])
    return labelled.groupBy("_day").agg(
        F.min("_ts").alias("_first"), F.max("_ts").alias("_last"),
        *[F.sum(f"_m{i}").cast("double").alias(f"_s{i}") for i in range(len(metrics))],
        *[F.count(f"_m{i}").alias(f"_n{i}") for i in range(len(metrics))]).checkpoint(eager=True)


def resample(df: DataFrame, time: str, metrics: Sequence[str], freq: str = "auto") -> DataFrame:
    """Mean of each metric per calendar period, empty periods included.

    (period date, metric...).  Rows with a missing time are left out.  The
    source is read once, into daily sums with map-side partial aggregation;
    the spine of periods has one row per period, so the final join is small.
    """
    return _resample(df, time, metrics, freq)[0]


def _resample(df: DataFrame, time: str, metrics: Sequence[str], freq: str) -> tuple[DataFrame, str]:
    daily = _daily(as_timestamp(df, time), time, metrics)
    if freq and freq.lower() != "auto":
        freq = freq.upper()
    else:
        days = floor_days(F.col("lo"), F.col("hi"))
        row = daily.agg(F.min("_first").alias("lo"), F.max("_last").alias("hi")) \
            .select(frequency_expr(days).alias("f"), F.col("lo").isNotNull().alias("any")).first()
        freq = row["f"] if row["any"] else "D"
    means = daily.groupBy(period_label(F.col("_day").cast("timestamp_ntz"), freq).alias("period")).agg(
        *[F.try_divide(F.sum(f"_s{i}"), F.sum(f"_n{i}")).alias(m) for i, m in enumerate(metrics)])
    bounds = means.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    return _spine(bounds, freq).join(means, "period", "left").select(
        "period", *[ref(m).cast("double").alias(m) for m in metrics]), freq


def trend(series: DataFrame, metrics: Sequence[str], order_by: str = "period") -> DataFrame:
    """Linear trend of each metric over its position among non-missing periods.

    (metric, points, slope, intercept, r, direction, strength).  Needs more
    than one value; slope > 0 -> increasing else decreasing; strength = |r|,
    0 for a constant series.  The series has one row per period.
    """
    long = series.select(ref(order_by), *[ref(m).cast("double").alias(m) for m in metrics]).unpivot(
        [ref(order_by)], [ref(m) for m in metrics], "metric", "value").where(F.col("value").isNotNull())
    w = Window.partitionBy("metric").orderBy(ref(order_by))
    pos = long.withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    fit = pos.groupBy("metric").agg(
        F.count("value").alias("points"),
        F.regr_slope("value", "x").alias("slope"),
        F.regr_intercept("value", "x").alias("intercept"),
        pairwise_corr(F.col("x"), F.col("value")).alias("r_raw"),
        F.stddev_samp("value").alias("sd"))
    r = F.when(F.col("sd") == 0, F.lit(0.0)).otherwise(F.col("r_raw"))
    order = {m: i for i, m in enumerate(metrics)}
    ordinal = F.element_at(F.create_map(*[x for m, i in order.items() for x in (F.lit(m), F.lit(i))]),
                           F.col("metric"))
    return fit.where(F.col("points") > 1).select(
        "metric", ordinal.alias("ordinal"), "points", "slope", "intercept", r.alias("r"),
        F.when(F.col("slope") > 0, "increasing").otherwise("decreasing").alias("direction"),
        F.abs(r).alias("strength"))


def time_series(df: DataFrame, time: str, metrics: Sequence[str], freq: str = "auto") -> dict:
    """The composite analysis: frequency, resampled series of every metric and
    the trend of each.  Returns {"frequency", "data", "trend"}; a column that
    cannot be read as a time gives a "message" and no data."""
    metrics = list(metrics)
    if time not in df.columns or family_of(df.schema[time].dataType) not in (DATETIME, TEXT):
        return {"frequency": None, "data": None, "trend": None,
                "message": f"column {time!r} cannot be read as a time"}
    series, f = _resample(df, time, metrics, freq)
    return {"frequency": f, "data": series, "trend": trend(series, metrics)}
