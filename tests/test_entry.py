"""The driver contract module."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    mod = load_entry()
    df = mod.entry(spark)
    first = df.collect()
    second = mod.entry(spark).collect()
    assert len(first) > 0 and df.columns == mod.entry(spark).columns
    assert len(first) == len(second)


def test_queries_and_oracles_align():
    mod = load_entry()
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90
