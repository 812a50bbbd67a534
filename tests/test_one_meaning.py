"""Filters, previews and encodings whose result must not hang on a length, a
tie or a name."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tabsight.operators import predicates as P
from tabsight.operators import prepare as R
from tabsight.sources.sampling import head_tail


def lists_of(values, filler):
    """The same members in a list of 1,000 and of 1,001 entries."""
    return [values + [filler(i) for i in range(n - len(values))] for n in (P.ISIN_LIMIT, P.ISIN_LIMIT + 1)]


CASES = [
    ("decimal(12,2)", "2.56", [2.555, decimal.Decimal("7.1")], lambda i: 1000 + i, 0),
    ("decimal(12,2)", "2.56", [2.56, 1e30], lambda i: 1000 + i, 1),
    ("date", "2024-02-03", ["2024-02-03", "no day", datetime.datetime(2024, 2, 4, 5)], lambda i: f"{1900 + i % 99}-01-01", 1),
    ("date", "2024-02-03", [datetime.date(2024, 2, 3)], lambda i: datetime.date(1900, 1, 1 + i % 28), 1),
    ("timestamp_ntz", "2024-02-03 04:05:06", ["2024-02-03 04:05:06"], lambda i: datetime.datetime(1999, 1, 1, i % 24), 1),
    ("timestamp", "2024-02-03 04:05:06", [datetime.datetime(2024, 2, 3, 4, 5, 6)], lambda i: "1999-01-01", 1),
    ("int", "5", [5.0, 2.5, "x", None, True], lambda i: 1000 + i, 1), ("bigint", "5", ["5", 2**70], lambda i: -9 - i, 1),
    ("float", "0.5", [0.5, float("nan")], lambda i: 1000.0 + i, 1), ("double", "0.1", ["0.1"], lambda i: 1000 + i, 1),
    ("string", "5", [5, 2.5], lambda i: f"s{i}", 1), ("boolean", "true", [True, 1, "true"], lambda i: "x", 1),
    ("boolean", "true", [1, "true"], lambda i: "x", 0),
]


@pytest.mark.parametrize("kind, text, values, filler, want", CASES)
def test_a_longer_list_means_the_same(spark, kind, text, values, filler, want):
    df = spark.createDataFrame([(text,), (None,)], "t string").select(F.col("t").cast(kind).alias("v"))
    for members in lists_of(values, filler):
        assert P.apply_filters(df, [{"column": "v", "type": "multiselect", "value": members}]).count() == want


def test_head_and_tail_keep_ties(spark):
    ties = spark.createDataFrame([(1, i) for i in range(6)], "k int, v int")
    assert sorted(r.v for r in head_tail(ties, ["k"], 10).collect()) == list(range(6))
    many = spark.createDataFrame([(1, i) for i in range(50)], "k int, v int").repartition(4)
    assert sorted(r.v for r in head_tail(many, ["k"], 3).collect()) == [0, 1, 2, 47, 48, 49]
    alike = spark.createDataFrame([(1, 1)] * 9 + [(None, 2)], "k int, v int")
    assert sorted((r.k is None, r.v) for r in head_tail(alike, ["k"], 2).collect()) == [(False, 1)] * 3 + [(True, 2)]
    maps = many.withColumn("m", F.create_map(F.lit("a"), "v"))
    assert head_tail(maps, ["k"], 3).count() == 6


def test_names_that_clash(spark):
    df = spark.createDataFrame([("a", True, 1), ("b", False, 2), (None, True, 3)], "p string, p_a boolean, P_b int")
    out = R.one_hot(df, ["p"])
    assert out.columns == ["p_a", "P_b", "p_a_2", "p_b_2"]
    assert [tuple(r) for r in out.orderBy("P_b").collect()] == \
        [(True, 1, True, False), (False, 2, False, True), (True, 3, False, False)]
    steps = [{"type": "categorical_encoding", "method": "one_hot", "columns": ["p"]}]
    assert R.transform(df, R.fit(df, steps)).columns == out.columns
    again = R.label_encode(R.label_encode(df, ["p"]), ["p"])
    assert again.columns == ["p", "p_a", "P_b", "p_encoded"]
    assert [r.p_encoded for r in again.orderBy("P_b").collect()] == [0, 1, -1]
