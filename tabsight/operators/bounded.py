"""Bounded state kept by every task and merged by Spark.

Two aggregates that no built-in function offers without shuffling every value:
the ``k`` smallest distinct values of many columns, and the ``n`` rows with the
smallest keys.  A task reads its Arrow batches against the largest value it
keeps, so that once it has seen enough almost nothing passes the test; it emits
at most ``k`` values a column, or ``n`` rows, whatever it read.  Spark merges
those in two steps: by hash into many tasks, then the bounded rest of these.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import nan_to_null, ref

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ------------------------------------------------- smallest distinct values

def _keep_smallest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Array] = {}
        for batch in batches:
            for c in range(batch.num_columns):
                values, have = batch.column(c).drop_null(), held.get(c)
                if have is not None:
                    if len(have) == k:
                        values = values.filter(pc.less(values, have[k - 1]))
                    if len(values):
                        values = pa.concat_arrays([have, values])
                if len(values):
                    values = pc.unique(values)
                    held[c] = values.take(pc.array_sort_indices(values)[:k])
        for c, values in held.items():
            yield pa.RecordBatch.from_pydict({"column": pa.array([c] * len(values), pa.int32()),
                                              "value": values.cast(pa.string())})
    return run


def smallest_distinct(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """(column, value): the ``k`` smallest distinct present values of each
    column as text, in the order of their UTF-8 bytes.

    One scan for all columns.  A column with fewer than ``k`` rows in the
    result has exactly that many distinct values.  NaN counts as missing;
    values are compared whole, however long.
    """
    cols = list(cols)
    if not cols or k < 1:
        return df.sparkSession.createDataFrame([], "column string, value string")
    texts = df.select(*[nan_to_null(df, c).cast("string").alias(f"v{i}") for i, c in enumerate(cols)])
    kept = texts.mapInArrow(_keep_smallest(k), "column int, value string").distinct()
    order = Window.partitionBy("column").orderBy("value")
    least = kept.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    names = F.array(*[F.lit(c) for c in cols])
    return least.select(F.element_at(names, F.col("column") + 1).alias("column"), "value")


def few_distinct(df: DataFrame, cols: Sequence[str], below: int) -> DataFrame:
    """(column, few, n_unique): whether a column has fewer than ``below``
    distinct present values, and how many if so (null otherwise)."""
    cols = list(cols)
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "_i int, column string")
    seen = smallest_distinct(df, cols, below).groupBy("column").agg(F.count("value").alias("_n"))
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    return names.join(seen, "column", "left").orderBy("_i") \
        .select("column", (n < below).alias("few"), F.when(n < below, n).alias("n_unique"))


# ---------------------------------------------------- rows of smallest keys

#: Rows a task holds before it drops all but its smallest.
_SLACK = 4


def _keep_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, largest = [], 0, None

        def smallest():
            table = pa.Table.from_batches(held)
            return table.take(pc.sort_indices(table, [("_key", "ascending")])[:n]).combine_chunks()

        for batch in batches:
            if largest is not None:
                batch = batch.filter(pc.less(batch.column("_key"), largest))
            if batch.num_rows == 0:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= _SLACK * n:
                table = smallest()
                held, rows = table.to_batches(), table.num_rows
                if rows == n:
                    largest = table.column("_key")[n - 1]
        if held:
            yield from smallest().to_batches()
    return run


def _through_arrow(dtype: T.DataType) -> bool:
    """Types that travel to a task's Arrow batches and back."""
    if isinstance(dtype, T.ArrayType):
        return _through_arrow(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _through_arrow(dtype.keyType) and _through_arrow(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return all(_through_arrow(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.StringType, T.BinaryType, T.BooleanType, T.NumericType, T.DateType,
                              T.TimestampType, T.TimestampNTZType))


def smallest_rows(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The ``n`` rows (or all) with the smallest text ``key``, in its order.

    One scan.  Every task keeps ``n`` rows, the tasks of a hash exchange keep
    ``n`` of those, and the last step puts what is left in order.
    """
    if n < 1:
        return df.limit(0)
    names, back = list(df.columns), [f"c{i}" for i in range(len(df.columns))]
    keyed = df.select(key.cast("string").alias("_key"), *[ref(c).alias(b) for c, b in zip(names, back)])
    if all(_through_arrow(f.dataType) for f in df.schema.fields):
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in keyed.schema.fields])
        keyed = keyed.mapInArrow(_keep_rows(n), schema).repartition("_key").mapInArrow(_keep_rows(n), schema)
    return keyed.orderBy("_key").limit(n).select(*[F.col(b).alias(c) for c, b in zip(names, back)])
