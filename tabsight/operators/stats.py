"""Whole-table statistics (reference section: global aggregations).

Design rules:
* statistics of many columns are fused into one aggregate pass and then
  reshaped to one row per column (a Generate over a single row);
* exact quantiles shuffle no values: ranks are found by rounds of counting
  bins (``ranks``);
* NaN is treated as missing everywhere (pandas ``isna``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ..functions.scalars import ref
from pyspark.sql import types as T

from ..functions.aggregates import count_missing, sample_skewness
from ..functions.scalars import (DATETIME, NUMBER, TEXT, columns_of, family_of,
                                 is_missing, nan_to_null)
from .bounded import smallest_distinct
from .ranks import at_quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _cols(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(df.columns) if cols is None else [c for c in cols if c in df.columns]


def _numeric(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    nums = set(columns_of(df, NUMBER))
    return [c for c in _cols(df, cols) if c in nums]


# Columns summarised per aggregate pass.  A table wider than this is read in
# several passes over disjoint column sets (Parquet reads only the columns of
# each pass), which keeps every generated aggregate compact.
COLUMNS_PER_PASS = 64


def _to_long(wide: DataFrame, cols: Sequence[str], fields: Mapping[str, str],
             first_ordinal: int = 0) -> DataFrame:
    """Reshape one wide row with columns ``f"{field}__{col}"`` into one row per col."""
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(first_ordinal + i).alias("ordinal"),
                 *[F.col(f"`{f}__{c}`").cast(t).alias(f) for f, t in fields.items()])
        for i, c in enumerate(cols)
    ]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def per_column_passes(df: DataFrame, cols: Sequence[str], aggs_of, fields: Mapping[str, str],
                      shared=(), finish=None) -> DataFrame:
    """One row per column from aggregate passes of at most COLUMNS_PER_PASS columns.

    ``aggs_of(c)`` gives the aggregates of column ``c`` (named
    ``f"{field}__{c}"``); ``shared`` aggregates (e.g. the row count) are added to
    every pass; ``finish(wide, chunk)`` may add derived ``field__col`` columns.
    """
    out = None
    for start in range(0, len(cols), COLUMNS_PER_PASS):
        chunk = list(cols[start:start + COLUMNS_PER_PASS])
        wide = df.agg(*shared, *[a for c in chunk for a in aggs_of(c)])
        if finish is not None:
            wide = finish(wide, chunk)
        part = _to_long(wide, chunk, fields, first_ordinal=start)
        out = part if out is None else out.unionByName(part)
    return out


def per_column(df: DataFrame) -> DataFrame:
    """Mark a table with one row per column for broadcast: its size is bounded
    by the schema width, not by the data."""
    return F.broadcast(df)


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


# ---------------------------------------------------------------- shape

def shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("bigint"))


def schema_listing(df: DataFrame) -> DataFrame:
    """Column names, Spark type and dtype family; read from the schema (no job)."""
    rows = [(i, f.name, f.dataType.simpleString(), family_of(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column string, dtype string, family string")


# ----------------------------------------------------- missing / unique

def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column: (column, ordinal, rows, missing, missing_pct)."""
    cols = _cols(df, cols)
    if not cols:
        return _empty(df, "column string, ordinal int, rows bigint, missing bigint, missing_pct double")
    long = per_column_passes(
        df, cols, lambda c: [count_missing(is_missing(df, c)).alias(f"missing__{c}")],
        {"rows": "bigint", "missing": "bigint"}, shared=[F.count(F.lit(1)).alias("rows")],
        finish=lambda w, chunk: w.select("*", *[F.col("rows").alias(f"rows__{c}") for c in chunk]))
    return long.withColumn("missing_pct", F.try_divide(F.col("missing") * 100.0, F.col("rows")))


def unique_counts(df: DataFrame, cols: Sequence[str] | None = None,
                  approx: bool = False, hash_texts: Sequence[str] = ()) -> DataFrame:
    """Distinct non-missing values per column: (column, ordinal, n_unique).

    Exact by default (``distinct_counts``).  Text columns named in ``hash_texts`` (long
    texts) are counted by digest, so no text is shuffled (see
    ``_text_distinct_counts``).  ``approx=True`` uses
    HyperLogLog++ sketches, which merge without shuffling the values at all.
    """
    cols = _cols(df, cols)
    if not cols:
        return _empty(df, "column string, ordinal int, n_unique bigint")
    if approx:
        return per_column_passes(
            df, cols, lambda c: [F.approx_count_distinct(nan_to_null(df, c)).alias(f"n_unique__{c}")],
            {"n_unique": "bigint"})
    texts = set(columns_of(df, TEXT)) & set(hash_texts)
    plain = [c for c in cols if c not in texts]
    hashed = [c for c in cols if c in texts]
    parts = []
    if plain:
        names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(plain)], "cid int, column string")
        parts.append(names.join(distinct_counts([(df, {c: i for i, c in enumerate(plain)})]), "cid", "left")
                     .select("column", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_unique")))
    if hashed:
        parts.append(_text_distinct_counts(df, hashed))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = {c: i for i, c in enumerate(cols)}
    ordinal = F.element_at(F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))]),
                           F.col("column"))
    return out.select("column", ordinal.alias("ordinal"), "n_unique")


def distinct_counts(tables: Sequence[tuple[DataFrame, Mapping[str, int]]]) -> DataFrame:
    """(cid, n): distinct non-missing values of the columns of many tables, for
    those that have any; each table comes with a number for each column.

    Columns of one type are stacked as (cid, value), so that a row of the
    exchange is two fields wide however many columns there are, and copies are
    combined in their map task.  One exchange a type for all tables; each
    column is read once."""
    by_type: dict = {}
    for df, numbers in tables:
        groups: dict = {}
        for c, i in numbers.items():
            dtype = df.schema[c].dataType
            kind = "bigint" if isinstance(dtype, T.IntegralType) else \
                "string" if isinstance(dtype, (T.CharType, T.VarcharType)) else dtype
            groups.setdefault(kind, {})[c] = i
        for kind, of in groups.items():
            cols = df.select(*[nan_to_null(df, c).cast(kind).alias(str(i)) for c, i in of.items()])
            long = cols.unpivot([], [ref(str(i)) for i in of.values()], "cid", "v").where(F.col("v").isNotNull())
            by_type.setdefault(kind, []).append(long.select(F.col("cid").cast("int").alias("cid"), "v"))
    counts = []
    for parts in by_type.values():
        counts.append(reduce(DataFrame.union, parts).distinct().groupBy("cid").agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.union, counts)


def _text_distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct counts of text columns by the SHA-256 of their values: one
    scan, and one exchange of digests whose copies are combined in their map
    task.  No text leaves its task."""
    digests = F.array(*[F.struct(F.lit(i).alias("cid"), F.unhex(F.sha2(ref(c).cast("string"), 256)).alias("v"))
                        for i, c in enumerate(cols)])
    long = df.select(F.explode(digests).alias("e")).select("e.*").where(F.col("v").isNotNull())
    counts = long.distinct().groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "cid int, column string")
    return names.join(counts, "cid", "left") \
        .select("column", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_unique"))


# ---------------------------------------------------------- quantiles

def _long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value double) for every non-missing numeric value."""
    vals = df.select(*[nan_to_null(df, c).cast("double").alias(c) for c in cols])
    return vals.unpivot([], [ref(c) for c in cols], "column", "value").where(F.col("value").isNotNull())


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75),
              exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """Quantiles with linear interpolation: (column, prob, value).

    ``exact=True`` reproduces pandas ``quantile`` (position p * (n - 1),
    interpolated between neighbours) by rounds of counting (``ranks``): two to
    four scans of the columns, and neither a shuffle nor a sort of values.

    ``exact=False`` uses mergeable ``percentile_approx`` sketches (rank error
    about 1/accuracy) in one pass.
    """
    cols = _numeric(df, cols)
    schema = "column string, prob double, value double"
    if not cols:
        return _empty(df, schema)
    probs = [float(p) for p in probs]
    if not exact:
        wide = df.agg(*[F.percentile_approx(nan_to_null(df, c).cast("double"), probs, accuracy)
                        .alias(f"q__{c}") for c in cols])
        return _explode_probs(wide, cols, probs)
    rows = []
    for start in range(0, len(cols), COLUMNS_PER_PASS):
        chunk = cols[start:start + COLUMNS_PER_PASS]
        found = at_quantiles(df, [nan_to_null(df, c) for c in chunk], probs)
        rows += [(c, p, v) for c, of in zip(chunk, found) for p, v in of.items()]
    return df.sparkSession.createDataFrame(rows, schema)


def _explode_probs(wide: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    long = _to_long(wide, cols, {"q": "array<double>"})
    return long.select("column", F.posexplode("q").alias("i", "value")).select(
        "column", F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("i") + 1).alias("prob"),
        "value")


def quantiles_wide(df: DataFrame, cols: Sequence[str], names: Mapping[str, float] = QUARTILES,
                   exact: bool = True) -> DataFrame:
    """(column, <name>...) with one quantile per named column."""
    long = quantiles(df, cols, list(names.values()), exact=exact)
    return long.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in names.items()])


# ------------------------------------------------------ numeric stats

def _moments(df: DataFrame, cols: Sequence[str], with_missing: bool = False) -> DataFrame:
    """count, mean, std, min, max (and optionally missing) per numeric column,
    in one pass."""
    def aggs_of(c):
        v = nan_to_null(df, c).cast("double")
        return [F.count(ref(v)).alias(f"count__{c}"), F.avg(ref(v)).alias(f"mean__{c}"),
                F.stddev_samp(ref(v)).alias(f"std__{c}"), F.min(ref(v)).alias(f"min__{c}"),
                F.max(ref(v)).alias(f"max__{c}")]

    fields = {"count": "bigint", "mean": "double", "std": "double", "min": "double", "max": "double"}
    if not with_missing:
        return per_column_passes(df, cols, aggs_of, fields)
    fields.update({"missing": "bigint", "rows": "bigint"})
    return per_column_passes(
        df, cols, aggs_of, fields, shared=[F.count(F.lit(1)).alias("_rows")],
        finish=lambda w, chunk: w.select(
            "*", *[(F.col("_rows") - F.col(f"`count__{c}`")).alias(f"missing__{c}") for c in chunk],
            *[F.col("_rows").alias(f"rows__{c}") for c in chunk]))


def numeric_stats(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """min, max, mean, median, std (ddof 1) per numeric column."""
    cols = _numeric(df, cols)
    if not cols:
        return _empty(df, "column string, ordinal int, min double, max double, mean double, "
                          "median double, std double")
    med = quantiles_wide(df, cols, {"median": 0.5}, exact=exact)
    return (_moments(df, cols).join(per_column(med), "column", "left")
            .select("column", "ordinal", "min", "max", "mean", "median", "std"))


def describe(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """pandas ``describe`` for numeric columns, one row per column."""
    cols = _numeric(df, cols)
    if not cols:
        return _empty(df, "column string, ordinal int, count bigint, mean double, std double, "
                          "min double, q25 double, q50 double, q75 double, max double")
    qs = quantiles_wide(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, exact=exact)
    return (_moments(df, cols).join(per_column(qs), "column", "left")
            .select("column", "ordinal", "count", "mean", "std", "min", "q25", "q50", "q75", "max"))


EPOCH = "1970-01-01 00:00:00"


def _micros(col):
    """Wall-clock microseconds since 1970 of a timestamp (no time zone involved)."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), col.cast("timestamp_ntz"))


def _from_micros(col):
    return F.timestamp_add("MICROSECOND", F.floor(col).cast("bigint"),
                           F.lit(EPOCH).cast("timestamp_ntz"))


def describe_datetime(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """pandas ``describe`` of datetime columns: count, mean, min, quartiles, max.

    (column, ordinal, count, mean, min, q25, q50, q75, max) as timestamps;
    statistics are taken on microseconds (floored back to a timestamp).
    """
    times = set(columns_of(df, DATETIME))
    cols = [c for c in _cols(df, cols) if c in times]
    if not cols:
        return _empty(df, "column string, ordinal int, count bigint, mean timestamp_ntz, "
                          "min timestamp_ntz, q25 timestamp_ntz, q50 timestamp_ntz, "
                          "q75 timestamp_ntz, max timestamp_ntz")
    as_num = df.select(*[_micros(ref(c)).cast("double").alias(c) for c in cols])
    moments = _moments(as_num, cols)
    qs = quantiles_wide(as_num, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(per_column(qs), "column", "left").select(
        "column", "ordinal", "count", *[_from_micros(ref(k)).alias(k)
                                        for k in ("mean", "min", "q25", "q50", "q75", "max")])


def describe_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """pandas ``describe`` of text columns: count, unique, top and its frequency.

    (column, ordinal, count, unique, top, freq); ``top`` is the most frequent
    value, the smallest one on ties.
    """
    texts = set(columns_of(df, TEXT))
    cols = [c for c in _cols(df, cols) if c in texts]
    if not cols:
        return _empty(df, "column string, ordinal int, count bigint, unique bigint, top string, "
                          "freq bigint")
    counts = _to_long(df.agg(*[F.count(ref(c)).alias(f"count__{c}") for c in cols]), cols,
                      {"count": "bigint"})
    uniq = unique_counts(df, cols).select("column", F.col("n_unique").alias("unique"))
    top = mode_value(df, cols).select("column", F.col("value").alias("top"), F.col("count").alias("freq"))
    return counts.join(per_column(uniq), "column").join(per_column(top), "column").select(
        "column", "ordinal", "count", "unique", "top", "freq")


def descriptive(df: DataFrame, metrics: Sequence[str], exact: bool = True) -> DataFrame:
    """The descriptive analysis: describe + missing + missing_pct (2 decimals).

    Missing counts come from the same pass as the moments (rows - count).
    """
    metrics = _numeric(df, metrics)
    if not metrics:
        return _empty(df, "column string, ordinal int, count bigint, mean double, std double, "
                          "min double, q25 double, q50 double, q75 double, max double, "
                          "missing bigint, missing_pct double")
    qs = quantiles_wide(df, metrics, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, exact=exact)
    pct = F.round(F.try_divide(F.col("missing") * 100.0, F.col("rows")), 2)
    return (_moments(df, metrics, with_missing=True).join(per_column(qs), "column", "left")
            .select("column", "ordinal", "count", "mean", "std", "min", "q25", "q50", "q75", "max",
                    "missing", pct.alias("missing_pct")))


def kpi(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """KPI card numbers: mean, min, max, std per metric."""
    metrics = _numeric(df, metrics)
    if not metrics:
        return _empty(df, "column string, ordinal int, mean double, min double, max double, std double")
    return _moments(df, metrics).select("column", "ordinal", "mean", "min", "max", "std")


def distribution(df: DataFrame, metrics: Sequence[str], exact: bool = True) -> DataFrame:
    """mean, median, sample skewness and shape; absent columns are skipped.

    shape: |skew| < 0.5 symmetrical, > 0 right-skewed, else left-skewed;
    undefined skewness (fewer than 3 values) gives a NULL shape.
    """
    metrics = _numeric(df, metrics)
    if not metrics:
        return _empty(df, "column string, ordinal int, mean double, median double, "
                          "skew double, shape string")
    aggs = []
    for c in metrics:
        v = nan_to_null(df, c).cast("double")
        aggs += [F.avg(ref(v)).alias(f"mean__{c}"), sample_skewness(v).alias(f"skew__{c}")]
    moments = _to_long(df.agg(*aggs), metrics, {"mean": "double", "skew": "double"})
    med = quantiles_wide(df, metrics, {"median": 0.5}, exact=exact)
    shape_col = (F.when(F.col("skew").isNull(), F.lit(None).cast("string"))
                  .when(F.abs("skew") < 0.5, "symmetrical")
                  .when(F.col("skew") > 0, "right-skewed")
                  .otherwise("left-skewed"))
    return (moments.join(per_column(med), "column", "left")
            .select("column", "ordinal", "mean", "median", "skew", shape_col.alias("shape")))


# --------------------------------------------------- fences / outliers

def fences(df: DataFrame, cols: Sequence[str], k: float = 1.5, exact: bool = True, quartiles=None) -> dict:
    """{column: (q1, q3, lower, upper)} -- a few fitted scalars per column.
    ``quartiles`` are rows with column, q1 and q3 where they are known already."""
    qs = quartiles if quartiles is not None else \
        quantiles_wide(df, cols, {"q1": 0.25, "q3": 0.75}, exact=exact).collect()
    out = {}
    for row in qs:
        if row["q1"] is None:
            continue
        iqr = row["q3"] - row["q1"]
        out[row["column"]] = (row["q1"], row["q3"], row["q1"] - k * iqr, row["q3"] + k * iqr)
    return out


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5,
                 exact: bool = True, quartiles=None) -> DataFrame:
    """Strict IQR outliers per numeric column.

    (column, ordinal, rows, q1, q3, lower, upper, outliers, whisker_low, whisker_high);
    two passes: quartiles, then one fused conditional count.
    """
    cols = _numeric(df, cols)
    schema = ("column string, ordinal int, rows bigint, q1 double, q3 double, lower double, "
              "upper double, outliers bigint, whisker_low double, whisker_high double")
    f = fences(df, cols, k, exact, quartiles)
    cols = [c for c in cols if c in f]
    if not cols:
        return _empty(df, schema)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        q1, q3, lo, hi = f[c]
        v = nan_to_null(df, c).cast("double")
        aggs += [F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).cast("bigint").alias(f"outliers__{c}"),
                 F.min(F.when(v >= F.lit(lo), v)).alias(f"whisker_low__{c}"),
                 F.max(F.when(v <= F.lit(hi), v)).alias(f"whisker_high__{c}")]
    wide = df.agg(*aggs)
    wide = wide.select("*", *[F.col("rows").alias(f"rows__{c}") for c in cols],
                       *[F.lit(f[c][i]).alias(f"{n}__{c}") for c in cols
                         for i, n in enumerate(("q1", "q3", "lower", "upper"))])
    return _to_long(wide, cols, {"rows": "bigint", "q1": "double", "q3": "double",
                                 "lower": "double", "upper": "double", "outliers": "bigint",
                                 "whisker_low": "double", "whisker_high": "double"})


def box_stats(df: DataFrame, metrics: Sequence[str], exact: bool = True) -> DataFrame:
    """Box-plot numbers: quartiles, fences, whiskers and outlier count."""
    metrics = _numeric(df, metrics)
    # quartiles and medians of one quantile run
    qs = quantiles_wide(df, metrics, QUARTILES, exact=exact).collect()
    box = iqr_outliers(df, metrics, 1.5, exact, quartiles=qs)
    med = df.sparkSession.createDataFrame([(r["column"], r["median"]) for r in qs], "column string, median double")
    return box.join(per_column(med), "column", "left").select(
        "column", "ordinal", "q1", "median", "q3", "lower", "upper",
        "whisker_low", "whisker_high", "outliers")


# ------------------------------------------------------- mode / dupes

def mode_value(df: DataFrame, cols: Sequence[str] | None = None,
               hash_texts: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-missing value per column, smallest value on ties.

    (column, ordinal, value string, count).  All columns are counted in one
    shuffle (grouping sets, map-side combine); the winner per column is a
    ``min`` over (-count, value) structs, which merges partially too.  Text
    columns in ``hash_texts`` (long texts) are resolved hash-first.
    """
    cols = _cols(df, cols)
    schema = "column string, ordinal int, value string, count bigint"
    if not cols:
        return _empty(df, schema)
    texts = set(columns_of(df, TEXT))
    hashed = [c for c in cols if c in texts and c in set(hash_texts)]
    plain = [c for c in cols if c not in hashed]
    parts = []
    if plain:
        picked = _mode_struct(df, plain)
        entries = [F.struct(F.lit(c).alias("column"), F.lit(cols.index(c)).alias("ordinal"),
                            F.col(f"m{i}.v").cast("string").alias("value"),
                            (-F.col(f"m{i}.n")).cast("bigint").alias("count"))
                   for i, c in enumerate(plain)]
        parts.append(picked.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    if hashed:
        modes = _text_modes(df, hashed)
        parts.append(df.sparkSession.createDataFrame(
            [(c, cols.index(c), *modes.get(c, (None, None))) for c in hashed], schema))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _mode_struct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    clean = df.select(*[nan_to_null(df, c).alias(c) for c in cols])
    counted = clean.groupingSets([[ref(c)] for c in cols], *[ref(c) for c in cols]).agg(
        F.count(F.lit(1)).alias("_cnt"), *[F.grouping(ref(c)).alias(f"_g{i}") for i, c in enumerate(cols)])
    return counted.agg(*[
        F.min(F.when((F.col(f"_g{i}") == 0) & ref(c).isNotNull(),
                     F.struct((-F.col("_cnt")).alias("n"), ref(c).alias("v")))).alias(f"m{i}")
        for i, c in enumerate(cols)])


def mode_scalars(df: DataFrame, cols: Sequence[str], hash_texts: Sequence[str] = ()) -> dict:
    """{column: typed mode value or None} -- one row to the driver.

    Text columns in ``hash_texts`` (long texts) are resolved hash-first
    (``_text_modes``); the others by one grouping-sets count.
    """
    cols = _cols(df, cols)
    if not cols:
        return {}
    texts = set(columns_of(df, TEXT))
    hashed = [c for c in cols if c in texts and c in set(hash_texts)]
    plain = [c for c in cols if c not in hashed]
    out = {}
    if plain:
        row = _mode_struct(df, plain).first()
        out.update({c: (row[f"m{i}"]["v"] if row[f"m{i}"] is not None else None)
                    for i, c in enumerate(plain)})
    if hashed:
        out.update({c: v for c, (v, _) in _text_modes(df, hashed).items()})
    return {c: out.get(c) for c in cols}


def _text_modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Exact modes of long-text columns without shuffling every text:
    {column: (value, count)}.

    Rows are counted per 96-bit value hash (small keys); only the values of
    the hashes reaching a column's highest count m are then counted exactly
    (map-side combined, so a hot text is no burden).  A value never occurs
    more often than its hash, so when the best exact count equals m every
    value with m occurrences is among those candidates and the answer is
    exact.  A collision could lift a hash above every real value; such a
    column falls back to counting all its values.
    """
    entries = [F.struct(F.lit(i).alias("cid"), ref(c).alias("v")) for i, c in enumerate(cols)]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("v").isNotNull())
    keyed = long.select("cid", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), "v")
    per_hash = keyed.groupBy("cid", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    top = per_hash.groupBy("cid").agg(F.max("n").alias("m"))
    cand = per_hash.join(F.broadcast(top), "cid").where(F.col("n") == F.col("m")).select("cid", "h1", "h2", "m")
    exact = (keyed.join(cand.drop("m"), ["cid", "h1", "h2"], "left_semi")
             .groupBy("cid", "v").agg(F.count(F.lit(1)).alias("n")))
    best = exact.groupBy("cid").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("v").alias("v"))).alias("b"))
    rows = best.join(F.broadcast(top), "cid").collect()  # one row per column
    out, fallback = {}, []
    for r in rows:
        c = cols[r["cid"]]
        if -r["b"]["neg"] == r["m"]:
            out[c] = (r["b"]["v"], int(r["m"]))
        else:
            fallback.append(c)
    if fallback:
        row = _mode_struct(df, fallback).first()
        out.update({c: ((row[f"m{i}"]["v"], int(-row[f"m{i}"]["n"])) if row[f"m{i}"] is not None
                        else (None, None)) for i, c in enumerate(fallback)})
    return out


def _bytes_of(col: Column, dtype: T.DataType) -> Column:
    """Text that two values share only if they are equal; it ends itself, so
    that the texts of several values can be joined.  Missing equals missing,
    NaN equals NULL in a column of its own, -0.0 equals 0.0."""
    if isinstance(dtype, T.ArrayType):
        parts = F.transform(col, lambda x: _bytes_of(x, dtype.elementType))
        return F.coalesce(F.concat(F.size(col).cast("string"), F.lit("["), F.array_join(parts, "")), F.lit("n;"))
    if isinstance(dtype, T.StructType):
        fields = [_bytes_of(col.getField(f.name), f.dataType) for f in dtype.fields]
        return F.when(col.isNull(), F.lit("n;")).otherwise(F.concat(F.lit("{"), *fields))
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        text = F.base64(col) if isinstance(dtype, T.BinaryType) else col.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n;"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        col = F.when(col == 0, F.lit(0.0).cast(dtype)).otherwise(col)
    if isinstance(dtype, T.TimestampType):  # its text has one hour twice a year
        col = F.unix_micros(col)
    return F.coalesce(F.concat(col.cast("string"), F.lit(";")), F.lit("n;"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows repeating an earlier identical row (missing equals missing).

    (rows, duplicates).  One scan and one exchange: rows are counted by the
    SHA-256 of a text that only equal rows share, so a count of digests is a
    count of rows and nothing has to be read again.  Copies are combined in
    their map task; a row that holds a third of the table reaches its reducer
    as one count a task.
    """
    digest = F.unhex(F.sha2(F.concat(*[
        _bytes_of(nan_to_null(df, f.name), f.dataType) for f in df.schema.fields], F.lit("")), 256))
    groups = df.groupBy(digest.alias("_digest")).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0)
    return groups.agg(F.coalesce(F.sum("_n"), zero).cast("bigint").alias("rows"),
                      F.coalesce(F.sum(F.col("_n") - 1), zero).cast("bigint").alias("duplicates"))


def column_samples(df: DataFrame, cols: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """Up to ``n`` distinct non-missing values per text column, as strings.

    Row order does not exist in Spark, so the ``n`` smallest values are taken:
    one scan for all columns (``bounded.smallest_distinct``).
    """
    texts = set(columns_of(df, TEXT))
    cols = [c for c in _cols(df, cols) if c in texts]
    if not cols:
        return _empty(df, "column string, samples array<string>")
    return smallest_distinct(df, cols, n).groupBy("column") \
        .agg(F.sort_array(F.collect_list("value")).alias("samples"))


def before_after_stats(before: DataFrame, after: DataFrame, cols: Sequence[str] | None = None,
                       limit: int | None = None) -> DataFrame:
    """Missing, mean and std before and after preparation.

    All numeric columns of ``before`` (or of ``cols``) that are still numeric
    in ``after``; with ``limit`` set, the first so many.
    """
    after_nums = set(columns_of(after, NUMBER))
    cols = [c for c in _numeric(before, cols) if c in after_nums][:limit]
    if not cols:
        return _empty(before, "column string, ordinal int, missing_before bigint, missing_after bigint, "
                              "mean_before double, mean_after double, std_before double, std_after double")

    def side(df, tag):
        aggs = []
        for c in cols:
            v = nan_to_null(df, c).cast("double")
            aggs += [count_missing(is_missing(df, c)).alias(f"missing_{tag}__{c}"),
                     F.avg(ref(v)).alias(f"mean_{tag}__{c}"), F.stddev_samp(ref(v)).alias(f"std_{tag}__{c}")]
        return _to_long(df.agg(*aggs), cols, {f"missing_{tag}": "bigint", f"mean_{tag}": "double",
                                              f"std_{tag}": "double"})

    b = side(before, "before")
    a = side(after, "after").drop("ordinal")
    return b.join(per_column(a), "column").select("column", "ordinal", "missing_before", "missing_after",
                                      "mean_before", "mean_after", "std_before", "std_after")
