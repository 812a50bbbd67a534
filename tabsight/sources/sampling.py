"""Samples and previews with an explicit order (Spark rows have none)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from ..functions.scalars import ref
from ..operators.bounded import smallest_rows


def sample_key(cols: Sequence[str]):
    """md5 of the key columns joined by '|' -- equal in Spark and DuckDB."""
    return F.md5(F.concat_ws("|", *[ref(c).cast("string") for c in cols]))


def sample_rows(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows (or all), reproducible: the rows with the smallest
    key hash, kept by bounded heaps in one scan (``bounded.smallest_rows``)."""
    return smallest_rows(df, sample_key(key), n)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample without a shuffle (size varies around fraction * rows)."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in ``order_by`` order."""
    return df.orderBy(*[ref(c) for c in order_by]).limit(n)


def head_tail(df: DataFrame, order_by: Sequence[str], limit: int = 10) -> DataFrame:
    """First and last ``limit`` rows; the whole frame when it has <= 2 * limit.

    Two top-k plans and a union.  Rows that tie in ``order_by`` are put in
    order by their other columns, so that no row is both head and tail; rows
    alike in every column count as often as they occur.
    """
    if df.limit(2 * limit + 1).count() <= 2 * limit:
        return df.orderBy(*[ref(c) for c in order_by])
    rest = [f.name for f in df.schema.fields if f.name not in order_by and not _unordered(f.dataType)]
    keys = [ref(c) for c in [*order_by, *rest]]
    head = df.orderBy(*[k.asc_nulls_first() for k in keys]).limit(limit)
    return head.union(df.orderBy(*[k.desc_nulls_last() for k in keys]).limit(limit))


def _unordered(dtype: T.DataType) -> bool:
    """Maps (and what holds them) have no order in Spark."""
    if isinstance(dtype, T.ArrayType):
        return _unordered(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_unordered(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.VariantType))
