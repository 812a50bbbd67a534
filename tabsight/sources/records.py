"""Result rows as JSON records (the data handed to a chart or dashboard)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..functions.scalars import ref


def to_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, built by the executors (no collect)."""
    return df.select(F.to_json(F.struct(*[ref(c) for c in df.columns])).alias("record"))


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write rows as JSON lines in parallel."""
    df.write.mode(mode).json(path)
    return path
