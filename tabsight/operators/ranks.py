"""Exact values at given ranks, by rounds of counting instead of sorting.

A double, read as a signed 64-bit number with the magnitude bits of negative
ones flipped, keeps its order.  Every round counts the values of all columns
by the next ``DIGIT`` bits of that number, keeps the bins that hold a wanted
rank and looks only into those in the next round:

* a task counts its Arrow batches in numpy and emits one row per bin it met
  (column, bin, count, smallest and largest value): bounded by bins, not rows;
* Spark adds them up and finds the bins of the wanted ranks in a window over
  the bins of a column (at most 2**DIGIT rows for each bin looked into);
* the driver receives one row per column and rank.

A bin with a single value is settled; when few values are left, the next round
counts them whole.  So most tables need two scans, any needs at most four, and
no value is shuffled, sorted across tasks or checkpointed.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGIT = 16
WHOLE = 64
#: With so few values left in all looked-at bins they are counted whole.
FEW = 1 << 16
_MAGNITUDE = np.int64(2**63 - 1)
_BINS = "column int, bin long, n long, low long, high long"


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers in the order of the doubles (-0.0 equals 0.0)."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & _MAGNITUDE)


def value_of(bits: int) -> float:
    b = np.array([bits], dtype=np.int64)
    return float((b ^ ((b >> np.int64(63)) & _MAGNITUDE)).view(np.float64)[0])


def _count_bins(shift: int, parent: int, wanted: Mapping[int, np.ndarray] | None):
    """Counts by ``bits >> shift``; with ``wanted``, only where ``bits >> parent``
    is one of the column's wanted bins (columns without one are skipped)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def merged(c):
            bins, n, low, high = (np.concatenate(x) for x in zip(*held[c]))
            order = np.argsort(bins, kind="stable")
            bins = bins[order]
            first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
            return (bins[first], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first),
                    np.maximum.reduceat(high[order], first))

        for batch in batches:
            for c in range(batch.num_columns):
                if wanted is not None and c not in wanted:
                    continue
                values = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                bits = ordered_bits(values[~np.isnan(values)])
                if wanted is not None:
                    above, keys = bits >> np.int64(parent), wanted[c]
                    at = np.minimum(np.searchsorted(keys, above), len(keys) - 1)
                    bits = bits[keys[at] == above]
                if len(bits) == 0:
                    continue
                bits.sort()
                bins = bits >> np.int64(shift)
                first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
                n = np.diff(np.append(first, len(bins)))
                held.setdefault(c, []).append((bins[first], n, bits[first], bits[first + n - 1]))
                if len(held[c]) >= 64:
                    held[c] = [merged(c)]
        for c in held:
            bins, n, low, high = merged(c)
            yield pa.RecordBatch.from_pydict({
                "column": pa.array(np.full(len(bins), c), pa.int32()), "bin": pa.array(bins, pa.int64()),
                "n": pa.array(n, pa.int64()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})
    return run


def _bins(values: DataFrame, shift: int, parent: int, wanted) -> DataFrame:
    return values.mapInArrow(_count_bins(shift, parent, wanted), _BINS) \
        .groupBy("column", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _holds(rank: Column) -> Column:
    return (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))


def at_quantiles(df: DataFrame, values: Sequence[Column], probs: Sequence[float]) -> list[dict[float, float]]:
    """For each of ``values`` (null and NaN are left out) its quantiles, by
    linear interpolation between the neighbouring ranks as pandas does; empty
    for a column without values."""
    values, probs = list(values), [float(p) for p in probs]
    out: list[dict[float, float]] = [{} for _ in values]
    if not values:
        return out
    plain = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    shift = WHOLE - DIGIT
    by_column = Window.partitionBy("column")
    bins = _bins(plain, shift, WHOLE, None) \
        .withColumn("upto", F.sum("n").over(by_column.orderBy("bin"))).withColumn("all", F.sum("n").over(by_column))
    place = F.col("prob") * (F.col("all") - 1)
    asked = bins.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs]))) \
        .withColumn("rank", F.explode(F.array(F.floor(place), F.ceil(place)))).filter(_holds(F.col("rank")))
    found = asked.distinct().collect()
    total = {r.column: r["all"] for r in found}
    settled: dict[tuple[int, int], float] = {}
    while found:
        open_ones = []
        for r in found:
            if r.low == r.high:
                settled[r.column, r["rank"]] = value_of(r.low)
            else:
                open_ones.append((r.column, r.bin, r["rank"], r.upto - r.n, r.n))
        if not open_ones:
            break
        left = sum({(c, b): n for c, b, _, _, n in open_ones}.values())
        parent, shift = shift, 0 if left <= FEW else shift - DIGIT
        wanted = {c: np.array(sorted({b for x, b, *_ in open_ones if x == c}), dtype=np.int64)
                  for c in {x[0] for x in open_ones}}
        # one row per column and wanted rank
        targets = df.sparkSession.createDataFrame(sorted({x[:4] for x in open_ones}),
                                                  "of int, above long, rank long, below long")
        above = F.shiftright("bin", parent - shift)
        inner = Window.partitionBy("column", "above").orderBy("bin")
        narrower = _bins(plain, shift, parent, wanted).withColumn("above", above) \
            .withColumn("upto", F.sum("n").over(inner))
        found = narrower.join(F.broadcast(targets), (F.col("column") == F.col("of"))
                              & (narrower["above"] == targets["above"])) \
            .withColumn("upto", F.col("upto") + F.col("below")).filter(_holds(F.col("rank"))) \
            .select("column", "bin", "n", "low", "high", "upto", "rank").collect()
    for c, n in total.items():
        for p in probs:
            where = p * (n - 1)
            low, high = settled[c, math.floor(where)], settled[c, math.ceil(where)]
            out[c][p] = low + (high - low) * (where - math.floor(where))
    return out
