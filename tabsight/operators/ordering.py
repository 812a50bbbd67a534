"""Running totals over a global order without a single-task window.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one
task.  ``running_total`` instead

1. range-partitions the rows on (group columns, order columns) and sorts
   each partition, so a large group is spread over many partitions;
2. checkpoints that layout once to the shared checkpoint folder (partition
   ids must not change between the passes below, and a lost executor must
   not re-shuffle it differently);
3. computes the running total inside each partition (Arrow batches through
   ``mapInPandas``; no shuffle);
4. sums each partition per group -- a table bounded by partitions + groups --
   and turns those sums into offsets with a small window;
5. broadcasts the offsets back and adds them.

Used by ``pareto`` (cumulative share), ``label_encode`` (dense codes) and the
exact quantiles (cumulative counts over a value histogram).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from ..functions.scalars import quoted, ref
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# The per-partition function runs in Python workers, which need not have this
# package installed: pickle this module's functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PID = "_ts_pid"
PTOTAL = "_ts_ptotal"
OFFSET = "_ts_offset"


def _row_key(row) -> tuple:
    return tuple(None if pd.isna(v) else v for v in row)


def _local_running(group_cols: Sequence[str], value_cols: Sequence[str],
                   out_cols: Sequence[str]):
    """Per-partition running totals; groups are contiguous (rows are sorted).

    Each value column keeps its own dtype, so integer totals stay exact int64
    (no float64 round trip, which would lose exactness beyond 2**53).
    """

    def run(batches):
        carry_key = None
        carry = [0] * len(value_cols)
        for pdf in batches:
            if pdf.empty:
                for v, o in zip(value_cols, out_cols):
                    pdf[o] = pd.Series(dtype=pdf[v].dtype)
                yield pdf
                continue
            run_id = None
            continues = False
            if group_cols:
                change = np.zeros(len(pdf), dtype=bool)
                for g in group_cols:
                    s = pdf[g]
                    prev = s.shift(1)
                    same = (s == prev) | (s.isna() & prev.isna())
                    change |= ~same.to_numpy()
                change[0] = _row_key(pdf[list(group_cols)].iloc[0]) != carry_key
                continues = not change[0]
                run_id = change.cumsum()
                carry_key = _row_key(pdf[list(group_cols)].iloc[-1])
            for i, (v, o) in enumerate(zip(value_cols, out_cols)):
                col = pdf[v].fillna(0)
                if run_id is None:
                    cum = col.cumsum().to_numpy() + carry[i]
                else:
                    cum = col.groupby(run_id).cumsum().to_numpy()
                    if continues:
                        cum = np.where(run_id == 0, cum + carry[i], cum)
                carry[i] = cum[-1]
                pdf[o] = cum
            yield pdf

    return run


def running_total(df: DataFrame, order: Sequence[Column | str],
                  value_cols: str | Sequence[str], out_cols: str | Sequence[str],
                  group_cols: Sequence[str] = (), num_partitions: int | None = None,
                  broadcast_offsets: bool = True) -> tuple[DataFrame, DataFrame]:
    """Add running sums of ``value_cols`` in ``order`` within groups.

    Returns ``(rows, totals)``: the rows with the running totals in
    ``out_cols``, and one row per group with the group's grand totals (named
    like ``out_cols``).  ``order`` should be a total order within a group
    (add a tie-breaker column) so the result is deterministic.

    ``broadcast_offsets`` may stay True when the number of groups is bounded
    (e.g. one group per column); otherwise the offsets are joined by a
    shuffle and AQE turns it into a broadcast when they prove small.
    """
    if isinstance(value_cols, str):
        value_cols = [value_cols]
    if isinstance(out_cols, str):
        out_cols = [out_cols]
    value_cols, out_cols = list(value_cols), list(out_cols)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [ref(c) for c in group_cols] + [ref(o) if isinstance(o, str) else o for o in order]
    # Without an explicit count, AQE sizes the range partitions by data volume
    # (coalescing keeps them contiguous ranges); the checkpoint then fixes them.
    ranged = (df.repartitionByRange(*keys) if num_partitions is None
              else df.repartitionByRange(num_partitions, *keys))
    sorted_rows = ranged.sortWithinPartitions(*keys)
    # Persisted first, so that writing the checkpoint re-reads these blocks
    # instead of re-running the range exchange; released once it is written.
    sorted_rows = sorted_rows.persist(StorageLevel.MEMORY_AND_DISK)
    laid_out = sorted_rows.checkpoint(eager=True)
    sorted_rows.unpersist()
    laid_out = laid_out.withColumn(PID, F.spark_partition_id())

    types = [df.schema[v].dataType for v in value_cols]
    # The Python step sees positional placeholder names (mapInPandas resolves
    # its input by name, which would read dots in user names as struct access).
    names = laid_out.columns
    safe = [f"_ts_c{i}" for i in range(len(names))]
    pos = {n: i for i, n in enumerate(names)}
    plain = laid_out.toDF(*safe)
    safe_out = [f"_ts_o{i}" for i in range(len(out_cols))]
    out_schema = T.StructType(list(plain.schema.fields)
                              + [T.StructField(o, t, True) for o, t in zip(safe_out, types)])
    local = plain.mapInPandas(
        _local_running([safe[pos[g]] for g in group_cols], [safe[pos[v]] for v in value_cols], safe_out),
        out_schema).toDF(*names, *out_cols)

    part_totals = laid_out.groupBy(PID, *[ref(g) for g in group_cols]).agg(*[
        F.coalesce(F.sum(ref(v)), F.lit(0)).cast(t).alias(f"{PTOTAL}{i}")
        for i, (v, t) in enumerate(zip(value_cols, types))])
    before = Window.partitionBy(*[ref(g) for g in group_cols]).orderBy(PID).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = part_totals.select(PID, *[ref(g) for g in group_cols], *[
        F.coalesce(F.sum(f"{PTOTAL}{i}").over(before), F.lit(0)).cast(t).alias(f"{OFFSET}{i}")
        for i, t in enumerate(types)])
    totals = part_totals.groupBy(*[ref(g) for g in group_cols]).agg(*[
        F.sum(f"{PTOTAL}{i}").cast(t).alias(o) for i, (o, t) in enumerate(zip(out_cols, types))])

    # The offsets table holds one row per (partition, group) that has rows:
    # at most num_partitions + number of groups rows.
    o = offsets.alias("o")
    if broadcast_offsets:
        o = F.broadcast(o)
    cond = [F.col(f"l.{PID}") == F.col(f"o.{PID}")] + [
        F.col(f"l.{quoted(g)}").eqNullSafe(F.col(f"o.{quoted(g)}")) for g in group_cols]
    joined = local.alias("l").join(o, cond, "inner")
    result = joined.select(
        *[F.col(f"l.{quoted(c)}") for c in df.columns],
        *[(F.col(f"l.{quoted(oc)}") + F.col(f"o.{OFFSET}{i}")).cast(t).alias(oc)
          for i, (oc, t) in enumerate(zip(out_cols, types))])
    return result, totals
