"""Column selection by name and by type family (schema only, no job)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..functions.scalars import ref

from ..functions.scalars import columns_of, is_missing


def project(df: DataFrame, cols: Sequence[str], missing: str = "skip") -> DataFrame:
    """Select ``cols``; absent names are skipped, or raise with ``missing="error"``."""
    absent = [c for c in cols if c not in df.columns]
    if absent and missing == "error":
        raise KeyError(f"columns not found: {absent}")
    return df.select(*[ref(c) for c in cols if c in df.columns])


def select_by_type(df: DataFrame, family: str) -> DataFrame:
    """Only the columns of one family: number, text, datetime, boolean."""
    return df.select(*[ref(c) for c in columns_of(df, family)])


def drop_column(df: DataFrame, col: str) -> DataFrame:
    return df.drop(col)


def where_missing(df: DataFrame, col: str, missing: bool = True) -> DataFrame:
    """Rows where ``col`` is missing (NULL or NaN), or present with ``missing=False``."""
    pred = is_missing(df, col)
    return df.where(pred if missing else ~pred)
