"""Property: the distributed running total equals pandas' grouped cumsum for
any data, tie pattern and number of partitions."""

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabsight.operators.ordering import running_total

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", None]), st.integers(-5, 5), st.integers(0, 100)),
    min_size=1, max_size=200)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, parts=st.integers(1, 9))
def test_running_total_equals_pandas(spark, rows, parts):
    data = [(g, v, i, w) for i, (g, v, w) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, v long, k long, w long")
    got, totals = running_total(df, ["v", "k"], ["w"], ["cum"], group_cols=["g"], num_partitions=parts)
    pdf = pd.DataFrame(data, columns=["g", "v", "k", "w"])
    pdf["g2"] = pdf["g"].fillna("<null>")
    pdf = pdf.sort_values(["g2", "v", "k"])
    pdf["cum"] = pdf.groupby("g2")["w"].cumsum()
    want = {(r.k, r.cum) for r in pdf.itertuples()}
    assert {(r["k"], r["cum"]) for r in got.collect()} == want
    want_totals = pdf.groupby("g2")["w"].sum().to_dict()
    got_totals = {("<null>" if r["g"] is None else r["g"]): r["cum"] for r in totals.collect()}
    assert got_totals == want_totals
