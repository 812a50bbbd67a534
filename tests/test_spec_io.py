"""Saving and loading the preparation spec through Spark's text source."""

import datetime as dt
import math

from tabsight.session import scratch_path
from tabsight.sources.spec import load_spec, save_spec


def test_round_trip_with_dates_and_nan(spark):
    steps = [{"type": "missing_values", "method": "imputation", "columns": ["x"],
              "parameters": {"strategy": "constant", "value": math.nan}},
             {"type": "date_conversion", "columns": ["d"],
              "parameters": {"since": dt.date(2024, 1, 2), "at": dt.datetime(2024, 1, 2, 3, 4, 5)}}]
    path = scratch_path(spark, "spec-test")
    save_spec(spark, steps, path)
    back = load_spec(spark, path)
    assert back[0]["parameters"]["value"] is None
    assert back[1]["parameters"] == {"since": "2024-01-02", "at": "2024-01-02T03:04:05"}
    save_spec(spark, back, path)  # overwriting keeps one line
    assert load_spec(spark, path) == back
