"""Column profile, quality issues and preparation suggestions.

``profile`` is one fused aggregate over the table (counts, distinct counts,
moments and date-format checks for every column at once), plus the exact
medians and the sample values; every later rule reads the profile rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..functions.scalars import quoted, ref

from ..functions.aggregates import count_missing
from ..functions.scalars import (DATETIME, NUMBER, TEXT, family_of,
                                 is_missing, is_numeric_text, nan_to_null, parse_with)
from . import stats as S
from .dates import column_formats, date_shapes

PROFILE_SCHEMA = ("column string, ordinal int, dtype string, family string, rows bigint, "
                  "missing bigint, missing_pct double, n_unique bigint, min double, max double, "
                  "mean double, median double, std double, date_format string, "
                  "samples array<string>")

ISSUE_SCHEMA = ("issue_order int, type string, column string, columns array<string>, "
                "affected_rows bigint, severity string, suggested_type string")

# Severity thresholds of the quality rules.
HIGH_MISSING_SHARE = 0.2        # any column above -> missing issue is "high"
DUPLICATE_MEDIUM_SHARE = 0.05   # duplicates above -> "medium", else "low"
OUTLIER_MEDIUM_SHARE = 0.05     # outliers above -> "medium", else "low"
NUMERIC_TEXT_SHARE = 0.5        # share of all rows that must read as numbers
ONE_HOT_BELOW = 10              # fewer distinct values -> one-hot, else label

# Text columns whose values average more characters than this are counted
# by value hash first (their texts are shuffled only when repeated).
LONG_TEXT = 64


def _parse(col, fmt):
    return parse_with(col, fmt)


def _date_format_expr(df: DataFrame, c: str, formats) -> tuple[list, F.Column]:
    """Aggregates counting values parsed by each format, and the chosen format.

    A text column is a date candidate when at least one value is present and
    every present value parses with one format; the first such format wins.
    """
    col = ref(c)
    present = F.count(ref(col)).alias(f"present__{c}")
    parsed = [F.count_if(_parse(col, f).isNotNull()).alias(f"parsed{k}__{c}")
              for k, f in enumerate(formats)]
    present_n = F.col(quoted(f"present__{c}"))
    pick = F.coalesce(*[
        F.when((present_n > 0) & (F.col(quoted(f"parsed{k}__{c}")) == present_n), F.lit(f))
        for k, f in enumerate(formats)])
    return [present, *parsed], pick


def long_text_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Text columns whose values are long: mean length above LONG_TEXT, over
    every row (one aggregate that reads only these columns)."""
    texts = [c for c in cols if family_of(df.schema[c].dataType) == TEXT]
    if not texts:
        return []
    row = df.agg(*[F.avg(F.length(ref(c))).alias(f"l{i}") for i, c in enumerate(texts)]).first()
    return [c for i, c in enumerate(texts) if row[f"l{i}"] is not None and row[f"l{i}"] > LONG_TEXT]


def _long_columns(shapes) -> list[str]:
    """The same from a collected histogram of shapes."""
    sums = {}
    for r in shapes:
        rows, chars = sums.get(r["column"], (0, 0))
        sums[r["column"]] = (rows + r["rows"], chars + r["chars"])
    return [c for c, (rows, chars) in sums.items() if chars > LONG_TEXT * rows]


def profile(df: DataFrame, cols: Sequence[str] | None = None,
            formats: Sequence[str] | None = None, exact: bool = True,
            approx_distinct: bool = False, samples: int = 10) -> DataFrame:
    """One row per column: type, missing, distinct, numeric stats, date format, samples.

    Date formats are found from the shapes of the texts, in the pass that
    measures their lengths, unless ``formats`` lists those to try."""
    cols = list(df.columns) if cols is None else [c for c in cols if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    fam = {c: family_of(df.schema[c].dataType) for c in cols}
    texts = [c for c in cols if fam[c] == TEXT]
    shapes = date_shapes(df, texts).collect()
    found = column_formats(df, shapes) if formats is None else {}
    # The main pass: missing counts, moments and date-format checks, at most
    # COLUMNS_PER_PASS columns per aggregate.
    none = F.lit(None).cast("double")
    parts = []
    for start in range(0, len(cols), S.COLUMNS_PER_PASS):
        chunk = cols[start:start + S.COLUMNS_PER_PASS]
        aggs = [F.count(F.lit(1)).alias("rows")]
        picks = {}
        for c in chunk:
            aggs.append(count_missing(is_missing(df, c)).alias(f"missing__{c}"))
            if fam[c] == NUMBER:
                v = nan_to_null(df, c).cast("double")
                aggs += [F.min(ref(v)).alias(f"min__{c}"), F.max(ref(v)).alias(f"max__{c}"),
                         F.avg(ref(v)).alias(f"mean__{c}"), F.stddev_samp(ref(v)).alias(f"std__{c}")]
            if fam[c] == TEXT and formats is None:
                picks[c] = F.lit(found.get(c)).cast("string")
            elif fam[c] == TEXT:
                more, picks[c] = _date_format_expr(df, c, formats)
                aggs += more
        wide = df.agg(*aggs)
        entries = []
        for c in chunk:
            i = cols.index(c)
            num = fam[c] == NUMBER
            entries.append(F.struct(
                F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.lit(fam[c]).alias("family"),
                F.col("rows").alias("rows"), F.col(f"`missing__{c}`").alias("missing"),
                F.try_divide(F.col(f"`missing__{c}`") * 100.0, F.col("rows")).alias("missing_pct"),
                *[(F.col(f"`{s}__{c}`") if num else none).alias(s) for s in ("min", "max", "mean", "std")],
                (picks[c] if c in picks else F.lit(None).cast("string")).alias("date_format")))
        parts.append(wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    base = parts[0]
    for p in parts[1:]:
        base = base.unionByName(p)
    long_texts = _long_columns(shapes)
    nums = [c for c in cols if fam[c] == NUMBER]
    out = base
    if nums:
        out = out.join(S.per_column(S.quantiles_wide(df, nums, {"median": 0.5}, exact=exact)), "column", "left")
    else:
        out = out.withColumn("median", none)
    # Exact distinct counts are one separate pass: mixed into the main
    # aggregate, Spark's distinct rewrite would copy every wide row once per
    # column.
    uniques = S.unique_counts(df, cols, approx=approx_distinct, hash_texts=long_texts).select("column", "n_unique")
    out = out.join(S.per_column(uniques), "column", "left")
    if texts and samples:
        out = out.join(S.per_column(S.column_samples(df, texts, samples)), "column", "left")
    else:
        out = out.withColumn("samples", F.lit(None).cast("array<string>"))
    return out.select("column", "ordinal", "dtype", "family", "rows", "missing", "missing_pct",
                      "n_unique", "min", "max", "mean", "median", "std", "date_format", "samples")


def date_candidates(df: DataFrame, cols: Sequence[str] | None = None,
                    formats: Sequence[str] | None = None) -> DataFrame:
    """Columns usable as time: real datetime columns and text in one date format.

    (column, ordinal, kind, format).  Formats are found in the data unless
    ``formats`` lists those to try.
    """
    cols = list(df.columns) if cols is None else list(cols)
    fam = {c: family_of(df.schema[c].dataType) for c in cols}
    texts = [c for c in cols if fam[c] == TEXT]
    rows = [(c, i, "datetime", None) for i, c in enumerate(cols) if fam[c] == DATETIME]
    spark = df.sparkSession
    dt = spark.createDataFrame(rows, "column string, ordinal int, kind string, format string")
    if not texts:
        return dt
    if formats is None:
        found = column_formats(df, date_shapes(df, texts).collect())
        return dt.unionByName(spark.createDataFrame(
            [(c, cols.index(c), "text", f) for c, f in found.items()], dt.schema))
    aggs, picks = [], {}
    for c in texts:
        more, picks[c] = _date_format_expr(df, c, formats)
        aggs += more
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(c).alias("column"), F.lit(cols.index(c)).alias("ordinal"),
                        F.lit("text").alias("kind"), picks[c].alias("format")) for c in texts]
    text_rows = wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(
        F.col("format").isNotNull())
    return dt.unionByName(text_rows)


# ------------------------------------------------------------- quality

def _issue(df: DataFrame, order: int, typ: str, column=None, columns=None, affected=None,
           severity=None, suggested=None) -> DataFrame:
    return df.select(
        F.lit(order).alias("issue_order"), F.lit(typ).alias("type"),
        (column if column is not None else F.lit(None)).cast("string").alias("column"),
        (columns if columns is not None else F.lit(None)).cast("array<string>").alias("columns"),
        (affected if affected is not None else F.lit(None)).cast("bigint").alias("affected_rows"),
        severity.alias("severity"),
        (suggested if suggested is not None else F.lit(None)).cast("string").alias("suggested_type"))


def quality_missing(df: DataFrame) -> DataFrame:
    """One issue listing every column of a table with missing values (none
    when clean); one fused count pass."""
    return quality_missing_of_profile(S.missing_counts(df))


def quality_missing_of_profile(prof: DataFrame) -> DataFrame:
    """The same from rows that hold the counts (profile or missing counts)."""
    with_missing = prof.where(F.col("missing") > 0)
    agg = with_missing.agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column"))),
                    lambda s: s["column"]).alias("cols"),
        F.max(F.try_divide(F.col("missing"), F.col("rows"))).alias("share"),
        F.sum("missing").alias("cells")).where(F.col("n") > 0)
    sev = F.when(F.col("share") > HIGH_MISSING_SHARE, "high").otherwise("medium")
    return _issue(agg, 0, "missing_values", columns=F.col("cols"), affected=F.col("cells"),
                  severity=sev)


def quality_duplicates(df: DataFrame) -> DataFrame:
    dup = S.duplicate_rows(df).where(F.col("duplicates") > 0)
    sev = F.when(F.try_divide(F.col("duplicates"), F.col("rows")) > DUPLICATE_MEDIUM_SHARE,
                 "medium").otherwise("low")
    return _issue(dup, 1, "duplicates", affected=F.col("duplicates"), severity=sev)


def quality_outliers(df: DataFrame, k: float = 1.5, exact: bool = True) -> DataFrame:
    out = S.iqr_outliers(df, None, k, exact).where(F.col("outliers") > 0)
    sev = F.when(F.try_divide(F.col("outliers"), F.col("rows")) > OUTLIER_MEDIUM_SHARE,
                 "medium").otherwise("low")
    return _issue(out, 2, "outliers", column=F.col("column"), affected=F.col("outliers"), severity=sev)


def quality_numeric_text(df: DataFrame) -> DataFrame:
    """Text columns where more than half of all rows read as numbers."""
    texts = [f.name for f in df.schema.fields if family_of(f.dataType) == TEXT]
    if not texts:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    wide = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(is_numeric_text(ref(c))).alias(f"num__{c}") for c in texts])
    entries = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                        F.col(f"`num__{c}`").alias("numeric"), F.col("rows").alias("rows"))
               for i, c in enumerate(texts)]
    long = wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    flagged = long.where(F.try_divide(F.col("numeric"), F.col("rows")) > NUMERIC_TEXT_SHARE)
    return _issue(flagged, 3, "inconsistent_type", column=F.col("column"), affected=F.col("numeric"),
                  severity=F.lit("medium"), suggested=F.lit("numeric"))


def quality_issues(df: DataFrame, prof: DataFrame | None = None) -> DataFrame:
    """All four rules in the reference's order: missing, duplicates, outliers, types."""
    missing = quality_missing(df) if prof is None else quality_missing_of_profile(prof)
    return (missing.unionByName(quality_duplicates(df))
            .unionByName(quality_outliers(df)).unionByName(quality_numeric_text(df)))


# --------------------------------------------------------- suggestions

SUGGESTION_SCHEMA = "seq bigint, type string, method string, column string, strategy string"
EXTRA_SCHEMA = SUGGESTION_SCHEMA + ", columns array<string>, parameters string"


def suggest_preprocessing(prof: DataFrame, extra: Sequence[dict] | None = None) -> DataFrame:
    """Preparation steps suggested from the profile rows.

    Missing values: mean for numbers, mode otherwise; date text: conversion
    with the detected format; text: one-hot below 10 distinct values, else
    label.  ``extra`` suggestions (dicts with type/method/columns/parameters)
    are appended whole, with all their parameters (JSON), unless a suggestion
    of their type for the same columns is there already; the result then has
    the columns ``columns`` and ``parameters`` too.
    """
    base = 1_000_000
    missing = prof.where(F.col("missing") > 0).select(
        (F.lit(0 * base) + F.col("ordinal")).cast("bigint").alias("seq"),
        F.lit("missing_values").alias("type"), F.lit("imputation").alias("method"), "column",
        F.when(F.col("family") == NUMBER, "mean").otherwise("mode").alias("strategy"))
    dates = prof.where((F.col("family") == TEXT) & F.col("date_format").isNotNull()).select(
        (F.lit(1 * base) + F.col("ordinal")).cast("bigint").alias("seq"),
        F.lit("date_conversion").alias("type"), F.lit(None).cast("string").alias("method"),
        "column", F.col("date_format").alias("strategy"))
    enc = prof.where(F.col("family") == TEXT).select(
        (F.lit(2 * base) + F.col("ordinal")).cast("bigint").alias("seq"),
        F.lit("categorical_encoding").alias("type"),
        F.when(F.col("n_unique") < ONE_HOT_BELOW, "one_hot").otherwise("label").alias("method"),
        "column", F.lit(None).cast("string").alias("strategy"))
    out = missing.unionByName(dates).unionByName(enc)
    if extra:
        rows, seen = [], set()
        for k, s in enumerate(extra):
            cols = list(s.get("columns") or [])
            key = (s.get("type"), tuple(cols))
            if key in seen:
                continue
            seen.add(key)
            params = s.get("parameters") or {}
            rows.append((3 * base + k, s.get("type"), s.get("method"), cols[0] if len(cols) == 1 else None,
                         params.get("strategy"), cols, json.dumps(params, sort_keys=True)))
        more = prof.sparkSession.createDataFrame(rows, EXTRA_SCHEMA)
        out = out.withColumn("columns", F.array("column")) \
            .withColumn("parameters", F.lit(None).cast("string"))
        taken = out.select(F.col("type").alias("_type"), F.col("columns").alias("_columns"))
        out = out.unionByName(more.join(
            taken, (F.col("type") == F.col("_type")) & (F.col("columns") == F.col("_columns")), "left_anti"))
    return out


def to_steps(suggestions: DataFrame) -> list[dict]:
    """Suggestion rows -> ordered step dicts for ``apply_pipeline``.

    At most a few rows per column reach the driver.
    """
    steps = []
    for r in suggestions.orderBy("seq").collect():
        whole = r.asDict()
        step = {"type": r["type"], "columns": list(whole.get("columns") or [r["column"]])}
        if r["method"] is not None:
            step["method"] = r["method"]
        if whole.get("parameters"):
            if json.loads(whole["parameters"]):
                step["parameters"] = json.loads(whole["parameters"])
            steps.append(step)
            continue
        if r["type"] == "missing_values" and r["strategy"]:
            step["parameters"] = {"strategy": r["strategy"]}
        if r["type"] == "date_conversion" and r["strategy"]:
            step["parameters"] = {"formats": [r["strategy"]]}
        steps.append(step)
    return steps
