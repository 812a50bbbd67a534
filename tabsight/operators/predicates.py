"""Dashboard filters: predicates, the values they offer and their kinds."""

from __future__ import annotations

import datetime
import decimal
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from ..functions.scalars import ref

from ..functions.scalars import NUMBER, family_of, nan_to_null
from .bounded import few_distinct

# A filter over fewer distinct values is a single select,
# otherwise a multiselect; "All" switches a single select off.
SELECT_BELOW = 10
ALL = "All"

# Membership lists longer than this are applied as a broadcast semi-join
# instead of an IN list (the list itself is the size bound).  Both compare the
# same typed values, so the length of a list never changes its meaning.
ISIN_LIMIT = 1000

_EXACT = decimal.Context(prec=100)


def typed_values(values: Sequence, dtype: T.DataType) -> list:
    """The distinct values of a membership list in the column's own type;
    values that no row of the column can equal (2.5 in a column of integers,
    text in a column of numbers) are left out, and so are missing ones."""
    out = []
    for v in values:
        if v is None or (isinstance(v, float) and math.isnan(v)):
            continue
        try:
            if isinstance(dtype, T.IntegralType):
                number = decimal.Decimal(str(v)) if not isinstance(v, bool) else decimal.Decimal(int(v))
                if number != number.to_integral_value():
                    continue
                v = int(number)
                if not -2**63 <= v < 2**63:
                    continue
            elif isinstance(dtype, (T.DoubleType, T.FloatType)):
                v = float(v)
            elif isinstance(dtype, T.DecimalType):
                v = decimal.Decimal(str(v))
                if v != v.quantize(decimal.Decimal(1).scaleb(-dtype.scale), context=_EXACT) \
                        or abs(v) >= decimal.Decimal(10) ** (dtype.precision - dtype.scale):
                    continue
            elif isinstance(dtype, T.BooleanType):
                if not isinstance(v, bool):
                    continue
            elif isinstance(dtype, T.DateType):
                at = _moment(v)
                if at.time() != datetime.time():
                    continue
                v = at.date()
            elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
                v = _moment(v)
            elif isinstance(dtype, T.StringType):
                v = str(v)
        except (TypeError, ValueError, ArithmeticError):
            continue
        out.append(v)
    return list(dict.fromkeys(out))


def _moment(value) -> datetime.datetime:
    """A day or time, or an ISO text of one, without a zone."""
    if isinstance(value, datetime.datetime):
        at = value
    elif isinstance(value, datetime.date):
        at = datetime.datetime.combine(value, datetime.time())
    else:
        at = datetime.datetime.fromisoformat(str(value))
    if at.tzinfo is not None:
        raise ValueError(f"a time without a zone is wanted: {value!r}")
    return at


def _as_literal(value):
    """The value as Spark reads it without a zone of the driver's (days and
    times travel as text and are cast there)."""
    return value.isoformat(" ") if isinstance(value, datetime.datetime) else \
        value.isoformat() if isinstance(value, datetime.date) else value


def _wide_type(dtype: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(dtype, T.IntegralType) else \
        T.DoubleType() if isinstance(dtype, T.FloatType) else dtype


def filter_predicate(df: DataFrame, spec: dict):
    """One filter as a Column predicate, or None when it is inactive."""
    col, kind, value = spec["column"], spec.get("type", "select"), spec.get("value")
    if col not in df.columns:
        return None
    c = ref(col)
    if kind == "select":
        if value is None or value == ALL:
            return None
        return c == F.lit(value)
    if kind == "multiselect":
        if not value:
            return None
        dtype = df.schema[col].dataType
        wide = _wide_type(dtype)
        known = [F.lit(_as_literal(v)).cast(wide) for v in typed_values(value, dtype)]
        return (c.cast(wide) if wide != dtype else c).isin(*known) if known else F.lit(False)
    if kind in ("range", "slider"):
        if family_of(df.schema[col].dataType) != NUMBER or value is None:
            return None
        lo, hi = value
        return c.between(F.lit(lo), F.lit(hi))
    raise ValueError(f"unknown filter type {kind!r}")


def apply_filters(df: DataFrame, filters: Sequence[dict]) -> DataFrame:
    """All active filters combined with AND (Catalyst merges and pushes them
    down to the scan).  Long membership lists become a broadcast semi-join."""
    out = df
    for spec in filters:
        value = spec.get("value")
        if (spec.get("type") == "multiselect" and value and len(value) > ISIN_LIMIT
                and spec["column"] in df.columns):
            dtype = df.schema[spec["column"]].dataType
            wide = _wide_type(dtype)
            known = [(_as_literal(v),) for v in typed_values(value, dtype)]
            as_text = isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
            schema = T.StructType([T.StructField("_member", T.StringType() if as_text else wide)])
            keys = df.sparkSession.createDataFrame(known, schema).select(F.col("_member").cast(wide).alias("_member"))
            out = out.join(F.broadcast(keys), ref(spec["column"]).cast(wide) == F.col("_member"), "left_semi")
            continue
        pred = filter_predicate(out, spec)
        if pred is not None:
            out = out.where(pred)
    return out


def filter_options(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) -- sorted distinct non-missing values per filter column, as text.

    One shuffle for all columns (each row emits one (column, value) pair per
    column; duplicates are removed map-side first).
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string")
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), nan_to_null(df, c).cast("string").alias("value"))
        for c in cols]))
    return df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct() \
        .orderBy("column", "value")


def filter_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, min, max) of numeric filter columns, one pass."""
    cols = [c for c in cols if c in df.columns and family_of(df.schema[c].dataType) == NUMBER]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, min double, max double")
    wide = df.agg(*[F.min(nan_to_null(df, c)).cast("double").alias(f"lo{i}") for i, c in enumerate(cols)],
                  *[F.max(nan_to_null(df, c)).cast("double").alias(f"hi{i}") for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("min"),
                        F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def filter_kinds(df: DataFrame, cols: Sequence[str], approx: bool = False, counts: bool = True) -> DataFrame:
    """(column, n_unique, kind): select below 10 distinct values, else multiselect.

    ``counts=False`` leaves ``n_unique`` null for a multiselect, and then one
    scan with bounded sets decides all columns (``bounded.few_distinct``).
    """
    if counts:
        from .stats import unique_counts
        u = unique_counts(df, cols, approx=approx).withColumn("few", F.col("n_unique") < SELECT_BELOW)
    else:
        u = few_distinct(df, [c for c in cols if c in df.columns], SELECT_BELOW)
    return u.select("column", "n_unique", F.when(F.col("few"), "select").otherwise("multiselect").alias("kind"))
