"""Pairwise correlation and the rankings built on it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..functions.scalars import ref

from ..functions.aggregates import pairwise_corr
from ..functions.scalars import NUMBER, columns_of, nan_to_null


# Pairs computed by one generated aggregate (each pair adds four aggregate
# functions); wider tables go through blocked sums.
PAIRS_PER_PASS = 128
# Columns of one side of a blocked pass: a task holds six matrices of this size
# squared, and a table of at most this many columns is read once.
PANEL = 512
# Columns of one side of a block that travels, and the first-step mergers of one.
BLOCK, MERGERS = 64, 16
# Deviation, relative to the mean, that is no more than rounding of doubles.
CONSTANT = 2e-15


def _clipped(r: F.Column) -> F.Column:
    """Rounding may leave a correlation just outside -1 to 1."""
    return F.when(F.abs(r) > 1, F.signum(r)).otherwise(r)


def correlation(df: DataFrame, cols: Sequence[str] | None = None,
                pairs_per_pass: int = PAIRS_PER_PASS) -> DataFrame:
    """Pairwise-complete Pearson correlation, long form.

    (col_x, col_y, x_ordinal, y_ordinal, corr, n) for every ordered pair,
    diagonal included (1.0 when the column varies).  At most
    ``pairs_per_pass`` pairs are one generated aggregate; more are computed as
    sums of blocks (``blocked_correlation``, one scan for 512 columns).  Only
    i <= j is computed and the other half mirrored.  A constant column gives
    NULL instead of an ANSI division error.
    """
    nums = set(columns_of(df, NUMBER))
    cols = [c for c in (cols if cols is not None else df.columns) if c in nums]
    schema = "col_x string, col_y string, x_ordinal int, y_ordinal int, corr double, n bigint"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    v = {c: nan_to_null(df, c).cast("double") for c in cols}
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    if len(pairs) > pairs_per_pass:
        return blocked_correlation(df, cols)
    aggs, entries = [], []
    for i, j in pairs:
        a, b = v[cols[i]], v[cols[j]]
        aggs.append(pairwise_corr(a, b).alias(f"r_{i}_{j}"))
        aggs.append(F.count(F.when(a.isNotNull() & b.isNotNull(), F.lit(1))).alias(f"n_{i}_{j}"))
        for x, y in sorted({(i, j), (j, i)}):
            entries.append(F.struct(F.lit(cols[x]).alias("col_x"), F.lit(cols[y]).alias("col_y"),
                                    F.lit(x).alias("x_ordinal"), F.lit(y).alias("y_ordinal"),
                                    _clipped(F.col(f"r_{i}_{j}")).alias("corr"),
                                    F.col(f"n_{i}_{j}").alias("n")))
    return df.agg(*aggs).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """n, mean x, mean y, and centred sums xx, yy, xy of all pairs of columns
    of ``x`` and ``y`` (NaN: missing), over the rows where both are present."""
    def shifted(v):
        seen = ~np.isnan(v)
        count = np.maximum(seen.sum(axis=0), 1)
        shift = np.where(seen, v, 0.0).sum(axis=0) / count
        # an infinity makes its column's shift infinite: such columns are not shifted
        shift = np.where(np.isfinite(shift), shift, 0.0)
        return np.where(seen, v - shift, 0.0), seen.astype(float), shift

    (a, ma, sa), (b, mb, sb) = shifted(x), shifted(y)
    n = ma.T @ mb
    some = np.maximum(n, 1.0)
    sx, sy = a.T @ mb, ma.T @ b
    return np.stack([n, sx / some + sa[:, None], sy / some + sb[None, :],
                     (a * a).T @ mb - sx * sx / some, ma.T @ (b * b) - sy * sy / some,
                     a.T @ b - sx * sy / some])


def _merged(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Moments of two disjoint sets of rows, put together."""
    n = p[0] + q[0]
    some = np.maximum(n, 1.0)
    share, dx, dy = q[0] / some, q[1] - p[1], q[2] - p[2]
    both = p[0] * share
    # a side without rows has no mean of its own
    mx = np.where(p[0] == 0, q[1], p[1] + np.where(q[0] == 0, 0.0, dx * share))
    my = np.where(p[0] == 0, q[2], p[2] + np.where(q[0] == 0, 0.0, dy * share))
    zero = both == 0
    dx, dy = np.where(zero, 0.0, dx), np.where(zero, 0.0, dy)
    return np.stack([n, mx, my, p[3] + q[3] + dx * dx * both, p[4] + q[4] + dy * dy * both,
                     p[5] + q[5] + dx * dy * both])


def _gram(left: int, right: int, same: bool):
    """Arrow batches of ``left + right`` columns to moments of their blocks,
    one set for each task."""
    def run(batches):
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            with np.errstate(all="ignore"):
                # infinities leave no correlation to their pairs and must not touch others
                bad = np.isinf(m)
                infinite = bad.any()
                x, y = (m, m) if same else (m[:, :left], m[:, left:])
                if infinite:
                    seen = (~np.isnan(m)).astype(float)
                    clean = np.where(bad, 0.0, m)
                    cx, cy = (clean, clean) if same else (clean[:, :left], clean[:, left:])
                    fresh = _moments(cx, cy)
                    bx, by = (bad, bad) if same else (bad[:, :left], bad[:, left:])
                    sx, sy = (seen, seen) if same else (seen[:, :left], seen[:, left:])
                    spoilt = (bx.T.astype(float) @ sy + sx.T @ by.astype(float)) > 0
                    fresh[3:, spoilt] = np.nan
                else:
                    fresh = _moments(x, y)
                state = fresh if state is None else _merged(state, fresh)
        if state is None:
            return
        for i in range(0, left, BLOCK):
            for j in range(i if same else 0, left if same else right, BLOCK):
                part = np.ascontiguousarray(state[:, i:i + BLOCK, j:j + BLOCK])
                yield pa.RecordBatch.from_pydict({
                    "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
                    "wide": pa.array([part.shape[2]], pa.int32()), "m": pa.array([part.tobytes()], pa.binary())})
    return run


def _join_blocks(group: pd.DataFrame) -> np.ndarray:
    out = None
    with np.errstate(all="ignore"):
        for raw, wide in zip(group["m"], group["wide"]):
            part = np.frombuffer(raw).reshape(6, -1, wide)
            out = part if out is None else _merged(out, part)
    return out


def _merge_some(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({k: [group[k].iloc[0]] for k in ("i", "j", "wide")} | {"m": [_join_blocks(group).tobytes()]})


def _finish(from_x: int, from_y: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        m = _join_blocks(group)
        n, cxx, cyy, cxy = m[0], m[3], m[4], m[5]
        with np.errstate(all="ignore"):
            scale = np.sqrt(np.maximum(cxx, 0.0)) * np.sqrt(np.maximum(cyy, 0.0))
            r = cxy / scale
            # a constant column's spread is rounding of its mean, if not zero
            still = (np.sqrt(cxx / n) <= CONSTANT * np.abs(m[1])) | (np.sqrt(cyy / n) <= CONSTANT * np.abs(m[2]))
        x, y = np.indices(n.shape)
        x, y = x + from_x + int(group["i"].iloc[0]), y + from_y + int(group["j"].iloc[0])
        out = pd.DataFrame({"x_ordinal": x.ravel(), "y_ordinal": y.ravel(), "corr": r.ravel(),
                            "undefined": ((n < 2) | (scale == 0) | still).ravel(), "n": n.ravel().astype("int64")})
        return out[out["x_ordinal"] <= out["y_ordinal"]]
    return run


def blocked_correlation(df: DataFrame, cols: Sequence[str], panel: int = PANEL) -> DataFrame:
    """The same result by blocked sums, for tables of many columns.

    Each task turns its Arrow batches into counts, means and centred products
    of all pairs of columns under their pairwise masks (matrix products) and
    emits one set of blocks of 64 x 64; blocks are merged in two steps, so that
    no group holds more than a share of the tasks.  The means travel with the
    sums, so large offsets cost no digits.  A pass takes two panels of
    ``panel`` columns: one scan up to that many columns, p (p + 1) / 2 scans
    for p panels.
    """
    cols = list(cols)
    v = [nan_to_null(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]
    starts = range(0, len(cols), panel)
    out = None
    for i in starts:
        for j in (s for s in starts if s >= i):
            x, y = v[i:i + panel], ([] if i == j else v[j:j + panel])
            blocks = df.select(*x, *y).mapInArrow(_gram(len(x), len(y), i == j), "i int, j int, wide int, m binary")
            some = blocks.withColumn("merger", F.spark_partition_id() % MERGERS).groupBy("i", "j", "merger") \
                .applyInPandas(_merge_some, "i int, j int, wide int, m binary")
            part = some.groupBy("i", "j").applyInPandas(
                _finish(i, j), "x_ordinal int, y_ordinal int, corr double, undefined boolean, n bigint")
            out = part if out is None else out.unionByName(part)
    every = out.withColumn("corr", F.when(~F.col("undefined"), _clipped(F.col("corr"))))
    # an empty table has no block: its pairs are there all the same
    size = len(cols)
    grid = df.sparkSession.range(size * size).select(
        F.floor(F.col("id") / size).cast("int").alias("x_ordinal"), (F.col("id") % size).cast("int").alias("y_ordinal"))
    low, high = F.least("x_ordinal", "y_ordinal"), F.greatest("x_ordinal", "y_ordinal")
    half = every.select(F.col("x_ordinal").alias("_x"), F.col("y_ordinal").alias("_y"), "corr", "n")
    names = F.array(*[F.lit(c) for c in cols])
    return grid.join(half, (low == F.col("_x")) & (high == F.col("_y")), "left").select(
        F.element_at(names, F.col("x_ordinal") + 1).alias("col_x"),
        F.element_at(names, F.col("y_ordinal") + 1).alias("col_y"), "x_ordinal", "y_ordinal", "corr",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """The correlations a column profile lists: every ordered pair of distinct
    columns, rounded, undefined ones left out.  (col_x, col_y, corr)."""
    corr = correlation(df, cols)
    return corr.where((F.col("x_ordinal") != F.col("y_ordinal")) & F.col("corr").isNotNull()).select(
        "col_x", "col_y", F.round("corr", digits).alias("corr"))


def strength_label(r) -> F.Column:
    """strong above 0.7, moderate above 0.3, else weak (on |r|)."""
    return (F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak"))


def top_correlations(corr: DataFrame, n: int = 3, digits: int = 2) -> DataFrame:
    """The ``n`` pairs with the largest |r| (each pair once, NULL and 0 left out).

    r is rounded to ``digits`` first, as the reference ranks the rounded
    matrix.  Ties go to the earlier pair (by column position).
    """
    pairs = corr.where((F.col("x_ordinal") < F.col("y_ordinal")) & F.col("corr").isNotNull())
    pairs = pairs.withColumn("r", F.round("corr", digits)).where(F.col("r") != 0)
    ranked = pairs.orderBy(F.desc(F.abs("r")), "x_ordinal", "y_ordinal").limit(n)
    return ranked.select("col_x", "col_y", "r",
                         F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"),
                         strength_label(F.col("r")).alias("strength"))


def strongest_pair(corr: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """The single pair with the largest |r|; with ``metrics`` both must be metrics."""
    pairs = corr.where((F.col("x_ordinal") < F.col("y_ordinal")) & F.col("corr").isNotNull())
    if metrics is not None:
        pairs = pairs.where(F.col("col_x").isin(list(metrics)) & F.col("col_y").isin(list(metrics)))
    return pairs.orderBy(F.desc(F.abs("corr")), "x_ordinal", "y_ordinal").limit(1).select(
        "col_x", "col_y", "corr", "n")
