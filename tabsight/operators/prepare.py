"""Ordered preparation steps (imputation, dates, scaling, encodings).

A step is a dict ``{"type", "method", "columns", "parameters"}``.  Steps run
in order and each fit sees the output of the steps before it.  A fit is one
small aggregate job whose result (a few scalars per column, or a bounded
category list) comes back to the driver; the transform itself stays a lazy
projection, so a whole pipeline is one Catalyst plan.  Each fit job reads
only the columns it needs (column pruning reaches the scan).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from ..functions.scalars import quoted, ref

from ..functions.scalars import (DATETIME, DEFAULT_DATE_FORMATS, NUMBER, TEXT, family_of,
                                 nan_to_null, parse_datetime)
from . import stats as S
from .dates import conversion_formats
from .ordering import running_total


def _numeric_cols(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns and family_of(df.schema[c].dataType) == NUMBER]


def _replace(df: DataFrame, new: dict) -> DataFrame:
    """Replace columns in place, keeping the column order."""
    return df.select(*[new[c].alias(c) if c in new else ref(c) for c in df.columns])


# ---------------------------------------------------------- imputation

def impute(df: DataFrame, cols: Sequence[str], strategy: str = "mean", value=None,
           exact: bool = True) -> DataFrame:
    """Fill missing values.

    mean / median: numeric columns only (others are left untouched);
    mode: any type, smallest most-frequent value, all-missing left as is;
    constant: ``value`` in the column's type; a number that an integer column
    cannot hold widens the column (to double, or to bigint where that is
    enough), and text for a number column is an error.
    """
    cols = [c for c in cols if c in df.columns]
    if strategy in ("mean", "median"):
        nums = _numeric_cols(df, cols)
        if not nums:
            return df
        if strategy == "mean":
            row = df.agg(*[F.avg(nan_to_null(df, c)).alias(c) for c in nums]).first()
            fills = {c: row[c] for c in nums}
        else:
            qs = S.quantiles_wide(df, nums, {"median": 0.5}, exact=exact).collect()
            fills = {r["column"]: r["median"] for r in qs}
        return _replace(df, {c: F.coalesce(nan_to_null(df, c), F.lit(fills.get(c)))
                             for c in nums if fills.get(c) is not None})
    if strategy == "mode":
        from .profile import long_text_columns
        fills = S.mode_scalars(df, cols, hash_texts=long_text_columns(df, cols))
        return _replace(df, {c: F.coalesce(nan_to_null(df, c), F.lit(v).cast(df.schema[c].dataType))
                             for c, v in fills.items() if v is not None})
    if strategy == "constant":
        new = {}
        for c in cols:
            dtype = df.schema[c].dataType
            fam = family_of(dtype)
            if value is None:
                continue
            if fam == NUMBER:
                try:
                    float(value)
                except (TypeError, ValueError):
                    raise ValueError(f"fill value {value!r} is not a number for column {c!r}")
            if isinstance(dtype, T.IntegralType):
                dtype = _holding_type(dtype, float(value))
                new[c] = F.coalesce(ref(c).cast(dtype), F.lit(value).cast(dtype))
            else:
                new[c] = F.coalesce(nan_to_null(df, c), F.lit(value).cast(dtype))
        return _replace(df, new)
    return df


_INTEGER_BITS = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def _holding_type(dtype: T.DataType, value: float) -> T.DataType:
    """The integer column's type, or the next one that holds ``value`` too."""
    if value != int(value):
        return T.DoubleType()
    if abs(value) < 2.0 ** _INTEGER_BITS[dtype.simpleString()]:
        return dtype
    return T.LongType() if abs(value) < 2.0 ** 63 else T.DoubleType()


def fill_missing(df: DataFrame, values: dict) -> DataFrame:
    """Fill missing values per column from ``{column: value}`` (pandas
    ``fillna`` with a dict); each value is converted to its column's type."""
    out = df
    for c, v in values.items():
        out = impute(out, [c], "constant", v)
    return out


def drop_missing_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a missing value (NULL or NaN) in any of ``cols``."""
    cols = [c for c in cols if c in df.columns]
    return df.na.drop(how="any", subset=[quoted(c) for c in cols]) if cols else df


# --------------------------------------------------------------- dates

def to_datetime(df: DataFrame, cols: Sequence[str],
                formats: Sequence[str] | Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Text -> timestamp (unparseable -> NULL); datetime columns are normalised.

    ``formats`` is one list for all columns or one for each; without it they
    are found in the data (``dates.conversion_formats``, one scan)."""
    cols = [c for c in cols if c in df.columns]
    texts = [c for c in cols if family_of(df.schema[c].dataType) == TEXT]
    if formats is None:
        formats = conversion_formats(df, texts, later=False)
    new = {}
    for c in cols:
        if c in texts:
            mine = formats.get(c, DEFAULT_DATE_FORMATS) if isinstance(formats, Mapping) else formats
            new[c] = parse_datetime(ref(c), mine)
        elif family_of(df.schema[c].dataType) == DATETIME:
            new[c] = ref(c).cast("timestamp_ntz")
    return _replace(df, new)


# ------------------------------------------------------------- scaling

def standardize(df: DataFrame, cols: Sequence[str], on_constant: str = "null") -> DataFrame:
    """(x - mean) / std (ddof 1).  A zero std gives NULL, or the value
    unchanged with ``on_constant="keep"``."""
    nums = _numeric_cols(df, cols)
    if not nums:
        return df
    row = df.agg(*[F.avg(nan_to_null(df, c)).alias(f"m_{i}") for i, c in enumerate(nums)],
                 *[F.stddev_samp(nan_to_null(df, c)).alias(f"s_{i}") for i, c in enumerate(nums)]).first()
    new = {}
    for i, c in enumerate(nums):
        m, s = row[f"m_{i}"], row[f"s_{i}"]
        x = nan_to_null(df, c).cast("double")
        if m is None:
            continue
        if not s:
            new[c] = x if on_constant == "keep" else F.lit(None).cast("double")
        else:
            new[c] = (x - F.lit(m)) / F.lit(s)
    return _replace(df, new)


def normalize(df: DataFrame, cols: Sequence[str], on_constant: str = "null") -> DataFrame:
    """(x - min) / (max - min); a constant column as in ``standardize``."""
    nums = _numeric_cols(df, cols)
    if not nums:
        return df
    row = df.agg(*[F.min(nan_to_null(df, c)).alias(f"lo_{i}") for i, c in enumerate(nums)],
                 *[F.max(nan_to_null(df, c)).alias(f"hi_{i}") for i, c in enumerate(nums)]).first()
    new = {}
    for i, c in enumerate(nums):
        lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
        x = nan_to_null(df, c).cast("double")
        if lo is None:
            continue
        if hi == lo:
            new[c] = x if on_constant == "keep" else F.lit(None).cast("double")
        else:
            new[c] = (x - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
    return _replace(df, new)


# ----------------------------------------------------------- encodings

def _category_name(value) -> str:
    return str(value)


def dummy_names(col: str, values: Sequence, taken: Sequence[str]) -> list[str]:
    """``<col>_<value>`` of every value; a name that is taken already, by a
    column or another value, gets the next free number (``_2``, ``_3``, ...)."""
    used, out = {x.lower() for x in taken}, []
    for v in values:
        name = plain = f"{col}_{_category_name(v)}"
        n = 1
        while name.lower() in used:
            n += 1
            name = f"{plain}_{n}"
        used.add(name.lower())
        out.append(name)
    return out


def categories(df: DataFrame, col: str, limit: int | None = None) -> list:
    """The sorted distinct values of a column.  They become column names, so
    the schema holds them all; a caller who wants a bound sets ``limit``, and
    more values than that raise (nothing is dropped)."""
    found = df.select(nan_to_null(df, col).alias("v")).where(F.col("v").isNotNull()).distinct()
    if limit is not None and found.limit(limit + 1).count() > limit:
        raise ValueError(f"{col!r} has more than {limit} categories; use label encoding or one_hot_long")
    return sorted(r[0] for r in found.collect())


def category_lists(df: DataFrame, limits: Mapping[str, int | None]) -> dict[str, list]:
    """:func:`categories` of several columns, in one scan and one exchange."""
    if not limits:
        return {}
    cols = list(limits)
    entries = [F.struct(F.lit(i).alias("of"), *[
        (nan_to_null(df, x) if i == j else F.lit(None).cast(df.schema[x].dataType)).alias(f"v{j}")
        for j, x in enumerate(cols)]) for i in range(len(cols))]
    present = [F.col(f"v{i}").isNotNull() for i in range(len(cols))]
    found = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*") \
        .where(F.array_contains(F.array(*present), True)).distinct()
    bounds = {i: limits[c] for i, c in enumerate(cols) if limits[c] is not None}
    if bounds:
        sizes = {r["of"]: r["n"] for r in found.groupBy("of").agg(F.count(F.lit(1)).alias("n")).collect()}
        for i, most in bounds.items():
            if sizes.get(i, 0) > most:
                raise ValueError(f"{cols[i]!r} has more than {most} categories; use label encoding or one_hot_long")
    out = {c: [] for c in cols}
    for r in found.collect():
        out[cols[r["of"]]].append(r[f"v{r['of']}"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot_long(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Long form of :func:`one_hot` for any number of categories: one row
    (key..., column, category) for each present value."""
    cols = [c for c in cols if c in df.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), nan_to_null(df, c).cast("string").alias("category"))
                                for c in cols]))
    return df.select(*[ref(k) for k in key], pairs.alias("_p")) \
        .select(*[ref(k) for k in key], "_p.column", "_p.category").where(F.col("category").isNotNull())


def one_hot(df: DataFrame, cols: Sequence[str], max_categories: int | None = None) -> DataFrame:
    """One boolean column ``<col>_<value>`` per sorted distinct value.

    Missing -> all false; the original column is dropped and the new ones
    go last.  ``max_categories`` is unset by default (see :func:`categories`).
    """
    out = df
    for c in cols:
        if c not in out.columns:
            continue
        value = nan_to_null(out, c)
        vals = categories(out, c, max_categories)
        keep = [ref(x) for x in out.columns if x != c]
        names = dummy_names(c, vals, [x for x in out.columns if x != c])
        dummies = [F.coalesce(value == F.lit(v), F.lit(False)).alias(name) for v, name in zip(vals, names)]
        out = out.select(*keep, *dummies)
    return out


def label_codes(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """(value, code) with code = position among the sorted distinct values.

    Dense codes come from the distributed running count, so a column with
    billions of distinct values is coded without a single-task window.
    Returns the code table and its row count.
    """
    values = df.select(nan_to_null(df, col).alias("value")).where(F.col("value").isNotNull()).distinct()
    distinct = values.withColumn("_one", F.lit(1).cast("bigint"))
    ranked, totals = running_total(distinct, ["value"], "_one", "_cum")
    total = totals.first()
    n = int(total["_cum"]) if total is not None and total["_cum"] is not None else 0
    return ranked.select("value", (F.col("_cum") - 1).cast("bigint").alias("code")), n


# Code tables of at most this many rows are broadcast by name: a checkpoint has
# no size that Spark knows before it has shuffled the other side.
FEW_CODES = 1000


def code_table(df: DataFrame, col: str) -> DataFrame:
    """The codes of :func:`label_codes` written once, for any number of joins
    (a stream joins them to every batch)."""
    codes, n = label_codes(df, col)
    codes = codes.checkpoint(eager=True)
    return F.broadcast(codes) if n <= FEW_CODES else codes


# Missing values have no code to meet; they are spread over this many keys, so
# that a column of mostly missing values does not fill one task of the join.
MISSING_SPREAD = 1024


def attach_codes(df: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    """Add ``<col>_encoded`` from a (value, code) table, -1 for missing.  The
    join strategy is left to Spark (AQE broadcasts a small table from its
    measured size and splits a skewed value)."""
    named = codes.select(F.col("value").alias("_lbl_value"), F.col("code").alias("_lbl_code"),
                         F.lit(0).alias("_lbl_zero"))
    value = nan_to_null(df, col)
    spread = F.when(value.isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(MISSING_SPREAD)) + 1) \
        .otherwise(F.lit(0)).cast("int")
    keyed = df.withColumn("_lbl_spread", spread)
    joined = keyed.join(named, (nan_to_null(keyed, col) == F.col("_lbl_value"))
                        & (F.col("_lbl_spread") == F.col("_lbl_zero")), "left")
    code, name = F.coalesce(F.col("_lbl_code"), F.lit(-1)).cast("bigint"), f"{col}_encoded"
    if name in df.columns:  # assigned anew, in its place
        return joined.select(*[code.alias(x) if x == name else ref(x) for x in df.columns])
    return joined.select(*[ref(x) for x in df.columns], code.alias(name))


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_encoded``: the code of the value, -1 for missing."""
    out = df
    for c in cols:
        if c in out.columns:
            out = attach_codes(out, c, code_table(out, c))
    return out


# ------------------------------------------------------------ pipeline

# Step vocabulary of the preparation spec.
STEP_TYPES = ("missing_values", "date_conversion", "standardization", "normalization",
              "categorical_encoding")


def _is_moment_step(step: dict) -> bool:
    """Steps fitted by means, deviations and bounds alone."""
    if step.get("type") in ("standardization", "normalization"):
        return True
    params = step.get("parameters") or {}
    return (step.get("type") == "missing_values" and step.get("method") == "imputation"
            and params.get("strategy", "mean") == "mean")


def _moment_row(df: DataFrame, cols: Sequence[str]) -> dict:
    """{column: (mean, std, min, max)} of all columns, in one aggregate."""
    nums = list(dict.fromkeys(_numeric_cols(df, cols)))
    if not nums:
        return {}
    aggs = []
    for i, c in enumerate(nums):
        v = nan_to_null(df, c)
        aggs += [F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).cast("double").alias(f"l{i}"), F.max(v).cast("double").alias(f"h{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"a{i}"], row[f"s{i}"], row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(nums)}


def _fit_moment_step(df: DataFrame, step: dict, moments: dict) -> dict:
    cols = [c for c in step.get("columns") or [] if c in moments]
    if step["type"] == "missing_values":
        return {"kind": "fill", "values": {c: moments[c][0] for c in cols if moments[c][0] is not None}}
    keep = (step.get("parameters") or {}).get("on_constant", "null") == "keep"
    scale = {}
    for c in cols:
        mean, std, lo, hi = moments[c]
        shift, width = (mean, std) if step["type"] == "standardization" else (lo, None if lo is None else hi - lo)
        if shift is None:
            continue
        scale[c] = (shift, width) if width else ("keep" if keep else "null")
    return {"kind": "scale", "columns": scale}


def _fit_step(df: DataFrame, step: dict) -> dict | None:
    """What a step learns by itself (None: it changes nothing); the fits that
    steps share are in :func:`_fit_level`."""
    typ, method = step.get("type"), step.get("method")
    cols = [c for c in step.get("columns") or [] if c in df.columns]
    params = step.get("parameters") or {}
    if typ == "missing_values" and method == "drop_rows":
        return {"kind": "drop", "columns": cols}
    if typ == "missing_values" and method == "imputation" and params.get("strategy") == "constant":
        return {"kind": "constant", "columns": cols, "value": params.get("value")}
    if typ == "date_conversion" and params.get("formats"):
        return {"kind": "dates", "columns": cols, "formats": list(params["formats"])}
    if typ == "categorical_encoding" and method == "label":
        return {"kind": "label", "codes": {c: code_table(df, c) for c in cols}}
    return None  # unknown step types are no-ops, like the reference


def _new_category(value, column: str):
    """An error that names a category that was not there at the fit."""
    return F.raise_error(F.concat(F.lit(f"new category in column {column!r}: "), value.cast("string")))


def _transform_step(df: DataFrame, fitted: dict | None, strict: bool) -> DataFrame:
    if fitted is None:
        return df
    kind = fitted["kind"]
    if kind == "fill":
        return _replace(df, {c: F.coalesce(nan_to_null(df, c), F.lit(v).cast(df.schema[c].dataType)
                                           if fitted.get("typed") else F.lit(v))
                             for c, v in fitted["values"].items() if c in df.columns})
    if kind == "constant":
        return impute(df, fitted["columns"], "constant", fitted["value"])
    if kind == "drop":
        return drop_missing_rows(df, fitted["columns"])
    if kind == "dates":
        return to_datetime(df, fitted["columns"], fitted["formats"])
    if kind == "scale":
        new = {}
        for c, how in fitted["columns"].items():
            x = nan_to_null(df, c).cast("double")
            if how == "keep":
                new[c] = x
            elif how == "null":
                new[c] = F.lit(None).cast("double")
            else:
                new[c] = (x - F.lit(float(how[0]))) / F.lit(float(how[1]))
        return _replace(df, new)
    if kind == "one_hot":
        out = df
        for c, vals in fitted["categories"].items():
            value = nan_to_null(out, c)
            dummies = [F.coalesce(value == F.lit(v), F.lit(False)) for v in vals]
            if strict and vals:
                new = value.isNotNull() & ~value.isin(vals)
                dummies = [F.when(new, _new_category(value, c).cast("boolean")).otherwise(d) for d in dummies]
            keep = [ref(x) for x in out.columns if x != c]
            names = dummy_names(c, vals, [x for x in out.columns if x != c])
            out = out.select(*keep, *[d.alias(name) for d, name in zip(dummies, names)])
        return out
    if kind == "label":
        out = df
        for c, codes in fitted["codes"].items():
            coded = attach_codes(out, c, codes)
            if strict:
                code, value = ref(f"{c}_encoded"), nan_to_null(coded, c)
                new = value.isNotNull() & (code < 0)
                coded = coded.withColumn(f"{c}_encoded", F.when(new, _new_category(value, c).cast("bigint"))
                                         .otherwise(code))
            out = coded
        return out
    raise ValueError(f"unknown fitted step {kind!r}")


def _touched(step: dict) -> set[str]:
    """Lower-case names of the columns a step reads or writes."""
    names = {c.lower() for c in step.get("columns") or []}
    if step.get("type") == "categorical_encoding" and step.get("method") == "label":
        names |= {f"{c}_encoded" for c in names}
    return names


def _drops_rows(step: dict) -> bool:
    return step.get("type") == "missing_values" and step.get("method") == "drop_rows"


def fit_levels(steps: Sequence[dict], columns: Sequence[str]) -> list[list[int]]:
    """The steps by the level they can be fitted at, as lists of their places.

    A step waits for the earlier steps that touch one of its columns, and for
    every earlier encoding if it names a column that the table does not have
    (an encoding may make it).  A step that drops rows waits for all steps
    before it, and all after it wait for that one.
    """
    steps, known = list(steps), {c.lower() for c in columns}
    touched, level = [_touched(s) for s in steps], []
    for i, step in enumerate(steps):
        after = -1
        for j in range(i):
            made = steps[j].get("type") == "categorical_encoding" \
                and any(c.lower() not in known for c in step.get("columns") or [])
            if made or touched[i] & touched[j] or _drops_rows(step) or _drops_rows(steps[j]):
                after = max(after, level[j])
        level.append(after + 1)
    return [[i for i, x in enumerate(level) if x == k] for k in range(max(level, default=-1) + 1)]


def _fit_level(df: DataFrame, steps: Sequence[dict]) -> list[dict | None]:
    """Fits of steps on different columns: one aggregate for all moments, one
    series of counting rounds for all medians, one count for all modes, one
    scan for the formats of all dates and one for all category lists."""
    def wants(step, strategy):
        return (step.get("type") == "missing_values" and step.get("method") == "imputation"
                and (step.get("parameters") or {}).get("strategy", "mean") == strategy)

    def columns(chosen):
        return [c for s in chosen for c in s.get("columns") or [] if c in df.columns]

    moments = _moment_row(df, columns([s for s in steps if _is_moment_step(s)]))
    medians, modes, lists, formats = {}, {}, {}, {}
    at_median = _numeric_cols(df, columns([s for s in steps if wants(s, "median")]))
    if at_median:
        medians = {r["column"]: r["median"] for r in S.quantiles_wide(df, at_median, {"median": 0.5}).collect()}
    at_mode = columns([s for s in steps if wants(s, "mode")])
    if at_mode:
        from .profile import long_text_columns
        modes = S.mode_scalars(df, at_mode, hash_texts=long_text_columns(df, at_mode))
    free = [s for s in steps if s.get("type") == "date_conversion" and not (s.get("parameters") or {}).get("formats")]
    texts = [c for c in columns(free) if family_of(df.schema[c].dataType) == TEXT]
    if texts:
        formats = conversion_formats(df, texts)
    hot = [s for s in steps if s.get("type") == "categorical_encoding" and s.get("method") == "one_hot"]
    if hot:
        lists = category_lists(df, {c: (s.get("parameters") or {}).get("max_categories")
                                    for s in hot for c in columns([s])})
    out = []
    for step in steps:
        mine = columns([step])
        if _is_moment_step(step):
            out.append(_fit_moment_step(df, step, moments))
        elif wants(step, "median"):
            out.append({"kind": "fill", "values": {c: medians[c] for c in mine if medians.get(c) is not None}})
        elif wants(step, "mode"):
            out.append({"kind": "fill", "typed": True,
                        "values": {c: modes[c] for c in mine if modes.get(c) is not None}})
        elif step in free:
            out.append({"kind": "dates", "columns": mine,
                        "formats": {c: formats[c] for c in mine if c in formats}})
        elif step in hot:
            out.append({"kind": "one_hot", "categories": {c: lists[c] for c in mine}})
        else:
            out.append(_fit_step(df, step))
    return out


def _fit_and_apply(df: DataFrame, steps: Sequence[dict]) -> tuple[DataFrame, list]:
    """Steps of one level are fitted together, on what the levels before them
    made of the table; the result applies all steps in their own order."""
    steps, known = list(steps), {c.lower() for c in df.columns}
    fitted: list[dict | None] = [None] * len(steps)
    done: set[int] = set()

    def applied(pending: set[str] | None = None):
        """``df`` after the steps done; for a fit, without the codes that no
        pending step reads (a join that Catalyst could not leave out)."""
        out = df
        for i in sorted(done):
            if (pending is not None and pending <= known and fitted[i] and fitted[i]["kind"] == "label"
                    and not pending & {f"{c}_encoded".lower() for c in fitted[i]["codes"]}):
                continue
            out = _transform_step(out, fitted[i], strict=False)
        return out

    for places in fit_levels(steps, df.columns):
        pending = {c.lower() for i, s in enumerate(steps) if i not in done for c in s.get("columns") or []}
        so_far = applied(pending)
        for i, f in zip(places, _fit_level(so_far, [steps[i] for i in places])):
            fitted[i] = f
        done |= set(places)
    return applied(), fitted


def fit(df: DataFrame, steps: Sequence[dict]) -> list:
    """What the steps learn from ``df``, for :func:`transform` on other data:
    fill values, scales, category lists and code tables."""
    return _fit_and_apply(df, steps)[1]


def transform(df: DataFrame, fitted: Sequence[dict | None], strict: bool = True) -> DataFrame:
    """Apply fitted steps: same columns and same codes on any data.  A category
    that was not there at the fit is an error (``strict=False``: no dummy is
    set, the code is -1)."""
    out = df
    for f in fitted:
        out = _transform_step(out, f, strict)
    return out


def apply_step(df: DataFrame, step: dict) -> DataFrame:
    return apply_pipeline(df, [step])


def apply_pipeline(df: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """Apply the steps in order; statistics are fitted on the data given
    (re-applying a saved spec to new data re-fits them)."""
    return _fit_and_apply(df, steps)[0]
