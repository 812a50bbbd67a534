"""CSV with a header, pandas-style missing tokens and per-column type inference.

Spark's CSV reader accepts a single ``nullValue``; pandas treats a whole set
of tokens as missing and infers each column's type from all its values.  The
file is read as text, the tokens are nulled, one aggregate pass decides each
column's type (bigint, double, boolean or text), and the columns are cast.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from ..functions.scalars import ref

from ..functions.scalars import NUMERIC_TEXT_PATTERN

# The text tokens pandas reads as missing by default.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Boolean spellings pandas recognises in CSV text.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

# Holds the text of a row whose number of fields differs from the header's.
MALFORMED = "_malformed_row"

INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"


def read_csv(spark: SparkSession, path: str, na_tokens=PANDAS_NA_TOKENS, infer: bool = True,
             sep: str = ",", multiline: bool | None = None) -> DataFrame:
    """Read a header CSV; missing tokens -> NULL; types inferred in one pass.

    Quotes inside a quoted field are written doubled (``""``), as pandas
    reads them, and may hold line breaks.  A file with such fields cannot be
    split; whether there are any is found by one scan of the lines (a line
    with an odd number of quotes), unless ``multiline`` says so.  A row shorter
    than the header is padded with missing values; a longer one is an error,
    whatever its fields hold.
    """
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
        multiline = bool(spark.read.text(path).where(quotes % 2 == 1).head(1))

    def reader(mode):
        return (spark.read.option("header", True).option("inferSchema", False)
                .option("sep", sep).option("quote", '"').option("escape", '"')
                .option("multiLine", multiline).option("nullValue", None).option("emptyValue", "")
                .option("mode", mode))

    raw = reader("PERMISSIVE").csv(path)
    if raw.columns:
        marked = T.StructType([*raw.schema.fields, T.StructField(MALFORMED, T.StringType())])
        raw = reader("PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).schema(marked).csv(path)
        last = ref(raw.columns[-2])
        # a malformed row has fewer or more fields than the header: count the
        # separators outside quoted fields
        bare = F.regexp_replace(F.col(MALFORMED), f'(^|{re.escape(sep)})"(?:[^"]|"")*"', "$1")
        fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep))) + 1
        too_long = F.col(MALFORMED).isNotNull() & (fields > len(raw.columns) - 1)
        raw = raw.select(*[ref(c) for c in raw.columns[:-2]], F.when(
            too_long, F.raise_error(F.concat(F.lit("row with more fields than the header: "), F.col(MALFORMED)))
            .cast("string")).otherwise(last).alias(raw.columns[-2]))
    tokens = list(na_tokens)
    clean = raw.select(*[F.when(ref(c).isin(tokens), F.lit(None))
                         .otherwise(ref(c)).alias(c) for c in raw.columns])
    if not infer or not clean.columns:
        return clean
    checks = []
    for i, c in enumerate(clean.columns):
        v = ref(c)
        present = v.isNotNull()
        checks += [
            F.count(ref(v)).alias(f"n{i}"),
            F.count_if(present & v.rlike(INTEGER_PATTERN)
                       & F.trim(v).try_cast("bigint").isNotNull()).alias(f"int{i}"),
            F.count_if(present & v.rlike(NUMERIC_TEXT_PATTERN)).alias(f"num{i}"),
            F.count_if(present & v.isin(list(TRUE_TOKENS + FALSE_TOKENS))).alias(f"bool{i}"),
        ]
    try:
        row = clean.agg(*checks).first()
    except Exception as e:  # noqa: BLE001 -- re-raised with the file named, like the reference
        raise ValueError(f"error loading CSV {path}: {e}") from e
    cols = []
    for i, c in enumerate(clean.columns):
        v = ref(c)
        n = row[f"n{i}"]
        if n and row[f"int{i}"] == n:
            cols.append(F.trim(v).cast("bigint").alias(c))
        elif n and row[f"num{i}"] == n:
            cols.append(F.trim(v).try_cast("double").alias(c))
        elif n and row[f"bool{i}"] == n:
            cols.append(v.isin(list(TRUE_TOKENS)).alias(c))
        elif not n:
            # an all-missing column is numeric (float) in pandas
            cols.append(F.lit(None).cast("double").alias(c))
        else:
            cols.append(v.alias(c))
    return clean.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Header CSV without an index, written by the executors in parallel.
    Times are written in full (up to microseconds, without closing zeros)."""
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    df = df.select(*[ref(c).cast("string").alias(c) if c in times else ref(c) for c in df.columns])
    (df.write.mode(mode).option("header", True)
       .option("quote", '"').option("escape", '"')
       .csv(path))
    return path
