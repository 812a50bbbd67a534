"""Structured Streaming: re-apply a preparation spec to every new batch.

A batch replay re-fits the saved steps on replaced data (``apply_pipeline``).
A stream must not change its columns or codes between batches, so the steps
are fitted once, on what the source folder holds when the stream starts (or on
data the caller fitted them on), and each micro-batch is transformed with the
fitted values and appended to a table folder.  A category that was not there
at the fit stops the stream with an error.  The stream's own checkpoint makes a restarted job continue where it stopped, and
a batch is written with its batch id so a retried batch replaces its own
output instead of duplicating it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prepare import fit, transform


def replay_stream(spark: SparkSession, source: str, schema: T.StructType, steps: Sequence[dict],
                  sink: str, checkpoint: str, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None, available_now: bool = True,
                  fitted: Sequence[dict] | None = None):
    """Start the stream; returns the StreamingQuery.

    ``fitted`` are the results of ``prepare.fit`` on other data; without them
    the steps are fitted on the files already in ``source``.

    ``available_now=True`` processes everything present and stops (a batch
    job with exactly-once bookkeeping); otherwise it keeps running.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source)
    if fitted is None:
        fitted = fit(spark.read.format(fmt).schema(schema).load(source), steps)

    def prepare_batch(batch: DataFrame, batch_id: int) -> None:
        prepared = transform(batch, fitted).withColumn("_batch_id", F.lit(batch_id))
        (prepared.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_batch_id").parquet(sink))

    writer = stream.writeStream.foreachBatch(prepare_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_prepared(spark: SparkSession, sink: str) -> DataFrame:
    """The prepared rows written so far (without the batch id)."""
    return spark.read.option("mergeSchema", True).parquet(sink).drop("_batch_id")
