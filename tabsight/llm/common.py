"""Helpers shared by the text operators: row keys, checkpoints, word rules."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: ASCII white space that separates words, as a regular expression class body.
SPACES = r"\x20\x09-\x0D"
#: The same characters, literally (for trim).
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id, text`` (and named extras) with a null text read as empty.

    Other columns of the input are dropped here, so that columns an operator
    adds can never clash with columns a caller carries.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       *[F.col(c) for c in extra])


def row_key() -> Column:
    """64-bit key of a row's content: repeated rows share it, others don't.

    Joins on it also compare ``doc_id``, so two rows meet by accident only if
    they share the id and all 64 bits.
    """
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")), F.col("text"))


NO_ID = -(2**63)


def whole_rows(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs`` as one struct, so that no name can
    clash), ``key_id`` (a missing id as the least long) and ``key_rid``."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    given, text = F.col("row.doc_id").cast("long"), F.coalesce(F.col("row.text"), F.lit(""))
    return named.select("row", F.coalesce(given, F.lit(NO_ID)).alias("key_id"),
                        F.xxhash64(F.coalesce(given, F.lit(-1).cast("long")), text).alias("key_rid"))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array (empty for a blank text)."""
    # the space alone is among the characters trimmed by default; the rest are named
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")) \
        .otherwise(F.split(trimmed, f"[{SPACES}]+"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def task_count(spark: SparkSession, times: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times


def hash_sample(rows: DataFrame, size: int, key: str = "rid") -> DataFrame:
    """About ``size`` rows, chosen by the hash of their key."""
    n = rows.count()
    if n <= size:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * size / n))


def schema_of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def ships(module: str) -> None:
    """Send the functions of ``module`` to tasks by value, so that executors
    need no copy of this package on their import path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ships(__name__)
