"""Saving and loading a preparation spec (the ordered step list).

The spec is written through Spark's text source, so the path can be any
shared storage the cluster reads (not only a local disk of the driver).
"""

from __future__ import annotations

import datetime as _dt
import json
import math

from pyspark.sql import SparkSession


def _plain(value):
    if isinstance(value, (_dt.date, _dt.datetime)):
        return value.isoformat()
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def dumps(steps) -> str:
    return json.dumps(_plain(list(steps)), sort_keys=True)


def save_spec(spark: SparkSession, steps, path: str) -> str:
    spark.createDataFrame([(dumps(steps),)], "spec string").coalesce(1).write.mode(
        "overwrite").text(path)
    return path


def load_spec(spark: SparkSession, path: str) -> list[dict]:
    rows = spark.read.text(path).take(2)
    if len(rows) != 1:
        raise ValueError(f"expected one spec line at {path}, found {len(rows)}")
    return json.loads(rows[0][0])
