"""The file-stream replay of a preparation spec."""

import tempfile

from pyspark.sql import functions as F

from tabsight.operators.prepare import apply_pipeline, fit, transform
from tabsight.plans.tables import load
from tabsight.streaming.replay import read_prepared, replay_stream

from conftest import SF_SMALL

STEPS = [{"type": "missing_values", "method": "imputation", "columns": ["x"],
          "parameters": {"strategy": "mean"}},
         {"type": "categorical_encoding", "method": "label", "columns": ["f"]}]


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="tabsight-stream-")
    li = load(spark, SF_SMALL, "lineitem").select(
        "l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, None).otherwise(F.col("l_tax")).alias("x"),
        F.col("l_returnflag").alias("f"))
    li.write.parquet(f"{base}/src")
    q = replay_stream(spark, f"{base}/src", li.schema, STEPS, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    got = sorted(tuple(r) for r in read_prepared(spark, f"{base}/out").collect())
    want = sorted(tuple(r) for r in apply_pipeline(li, STEPS).collect())
    assert got == want


def test_codes_of_a_fit_are_written_once(spark):
    """A batch joins finished codes, and few of them without a shuffle of its rows."""
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "f string")
    fitted = fit(df, STEPS[1:])
    out = transform(df, fitted)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted((r["f"] or "", r["f_encoded"]) for r in out.collect()) == [("", -1), ("a", 0), ("b", 1), ("b", 1)]
