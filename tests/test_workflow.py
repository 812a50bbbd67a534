"""The end-to-end flow on one table."""

import os
import tempfile

from pyspark.sql import functions as F

from tabsight import workflow as W
from tabsight.plans.tables import lineitem_dirty
from tabsight.sources import write_csv

from conftest import SF_SMALL


def test_flow_on_lineitem(spark):
    df = lineitem_dirty(spark, SF_SMALL)
    out = W.profile_dataset(df)
    issues = {r["type"] for r in out["issues"].collect()}
    assert {"missing_values", "inconsistent_type"} <= issues
    prepared = W.prepare(df, out["suggestions"])
    assert "l_returnflag_encoded" not in prepared.columns  # 3 values -> one-hot
    assert any(c.startswith("l_returnflag_") for c in prepared.columns)
    assert prepared.where(F.col("l_discount").isNull()).count() == 0
    ctx = W.business_context(df)
    assert ctx["domain"] == "sales" and "l_returnflag" in ctx["dimensions"]
    configs = W.suggest_analyses(df)
    types = [c["type"] for c in configs]
    assert types[0] == "descriptive" and "grouping" in types
    results = W.run_analyses(df, configs)
    assert all(r["data"] is not None for r in results)
    assert results[0]["data"].count() == len(configs[0]["metrics"])


def test_csv_sample(spark):
    d = tempfile.mkdtemp(prefix="tabsight-flow-")
    path = os.path.join(d, "orders")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_orderstatus")
    write_csv(orders, path)
    a = W.load_csv(spark, path, sample=100, key=["o_orderkey"])
    b = W.load_csv(spark, path, sample=100, key=["o_orderkey"])
    assert a.count() == 100
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())
