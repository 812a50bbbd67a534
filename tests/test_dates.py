"""Date formats found from the shapes of the values."""

import datetime as dt

import pytest

from tabsight.operators import dates as D
from tabsight.operators import prepare as R
from tabsight.operators import profile as P

DAYS = [dt.datetime(2024, 1, 5, 9, 7, 3), dt.datetime(2024, 2, 13, 13, 30, 0), dt.datetime(2023, 12, 31, 0, 0, 59)]


def h(d):
    return (d.hour + 11) % 12 + 1


CASES = {
    "d/M/yyyy": lambda d: f"{d.day}/{d.month}/{d.year}",
    "dd/MM/yyyy": lambda d: d.strftime("%d/%m/%Y"),
    "MM/dd/yyyy": lambda d: d.strftime("%m/%d/%Y"),
    "dd-MM-yyyy": lambda d: d.strftime("%d-%m-%Y"),
    "dd.MM.yyyy": lambda d: d.strftime("%d.%m.%Y"),
    "yyyy-MM-dd": lambda d: d.strftime("%Y-%m-%d"),
    "yyyy/M/d": lambda d: f"{d.year}/{d.month}/{d.day}",
    "yyyyMMdd": lambda d: d.strftime("%Y%m%d"),
    "MMM d, yyyy": lambda d: f"{d:%b} {d.day}, {d.year}",
    "MMMM d, yyyy": lambda d: f"{d:%B} {d.day}, {d.year}",
    "dd MMM yyyy": lambda d: d.strftime("%d %b %Y"),
    "dd-MMM-yyyy": lambda d: d.strftime("%d-%b-%Y").upper(),
    "yyyy-MM-dd HH:mm:ss": lambda d: d.strftime("%Y-%m-%d %H:%M:%S"),
    "yyyy-MM-dd'T'HH:mm:ss'Z'": lambda d: d.strftime("%Y-%m-%dT%H:%M:%SZ"),
    "yyyy-MM-dd HH:mm:ss.SSS": lambda d: d.strftime("%Y-%m-%d %H:%M:%S.250"),
    "M/d/yyyy h:mm a": lambda d: f"{d.month}/{d.day}/{d.year} {h(d)}:{d:%M %p}",
    "dd/MM/yyyy H:mm": lambda d: f"{d:%d/%m/%Y} {d.hour}:{d:%M}",
}


@pytest.fixture(scope="module")
def table(spark):
    rows = [tuple(f(d) for f in CASES.values()) for d in DAYS]
    return spark.createDataFrame(rows + [tuple(None for _ in CASES)], [f"c{i}" for i in range(len(CASES))])


def expected(fmt, d):
    if "m" not in fmt:
        return d.replace(hour=0, minute=0, second=0)
    if "S" in fmt:
        return d.replace(microsecond=250000)
    return d if "ss" in fmt else d.replace(second=0)


def test_every_format_is_found_and_converted(spark, table):
    found = {r["column"]: r["format"] for r in P.date_candidates(table).collect()}
    assert found == {f"c{i}": f for i, f in enumerate(CASES)}
    out = [tuple(r) for r in R.to_datetime(table, table.columns).collect()]
    assert out == [tuple(expected(f, d) for f in CASES) for d in DAYS] + [tuple(None for _ in CASES)]


def test_profile_reports_them(spark, table):
    got = {r["column"]: r["date_format"] for r in P.profile(table.select("c1", "c8")).collect()}
    assert got == {"c1": "dd/MM/yyyy", "c8": "MMM d, yyyy"}


def test_order_of_day_and_month(spark):
    df = spark.createDataFrame([("01/02/2024", "01.02.2024", "13/02/2024"), ("03/04/2024", "03.04.2024", "02/13/2024"),
                                ("03/04/2024", "03.04.2024", "25/12/2024")], ["open", "dots", "both"])
    found = D.found_formats(D.date_shapes(df))
    assert [(f["format"], f["order_known"]) for f in found["open"]] == [("MM/dd/yyyy", False)]
    assert [(f["format"], f["order_known"]) for f in found["dots"]] == [("dd.MM.yyyy", False)]
    assert found["both"][0]["both_high"]
    assert {r["column"] for r in P.date_candidates(df).collect()} == {"open", "dots"}
    out = [r["both"] for r in R.to_datetime(df, ["both"]).collect()]  # the day comes first in more rows
    assert out == [dt.datetime(2024, 2, 13), None, dt.datetime(2024, 12, 25)]


def test_may_is_short_and_full(spark):
    df = spark.createDataFrame([("May 5, 2024",), ("June 6, 2024",)], ["t"])
    assert [r["format"] for r in P.date_candidates(df).collect()] == ["MMMM d, yyyy"]


def test_what_is_no_date(spark):
    df = spark.createDataFrame([("2024-02-30", "2024-01-05", "A 5, 2024", "", "12345678901", "x" * 5000),
                                ("2024-02-28", "soon", "F 5, 2024", "", "1", "2024-01-05")],
                               ["february", "mixed", "letters", "empty", "digits", "long"])
    assert P.date_candidates(df).collect() == []
    out = R.to_datetime(df, df.columns).collect()
    assert [r["february"] for r in out] == [None, dt.datetime(2024, 2, 28)]
    assert [r["mixed"] for r in out] == [dt.datetime(2024, 1, 5), None]
    assert P.date_candidates(df.where("false")).collect() == []


def test_conversion_step_learns_formats(spark, table):
    step = {"type": "date_conversion", "method": "to_datetime", "columns": ["c1"], "parameters": {}}
    out = [r["c1"] for r in R.apply_pipeline(table.select("c1"), [step]).collect()]
    assert out == [d.replace(hour=0, minute=0, second=0) for d in DAYS] + [None]
    fitted = R.fit(table.select("c1"), [step])
    later = spark.createDataFrame([("01/02/2024",), ("2024-03-04",)], ["c1"])
    assert [r["c1"] for r in R.transform(later, fitted).collect()] == [dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 4)]


def test_histogram_counts_every_value(spark):
    """Many batches, masked texts that differ, letters beside other scripts."""
    rows = [(f"{i % 28 + 1}/{i % 12 + 1}/2024", "5 Jan 2024" if i % 2 else "éJan 5, 2024") for i in range(25_000)]
    rows += [(None, None), ("x" * 60, "2024-01-05\r")]
    got = {(r["column"], r["shape"]): tuple(r)[3:] for r in D.date_shapes(spark.createDataFrame(rows, ["n", "t"])).collect()}
    days = [r[0] for r in rows[:-2]]
    for shape in {"".join("9" if x.isdigit() else x for x in d) for d in days}:
        mine = [d for d in days if "".join("9" if x.isdigit() else x for x in d) == shape]
        f = [[int(x) for x in d.split("/")] for d in mine]
        assert got[("n", shape)] == (len(mine), sum(map(len, mine)), max(x[0] for x in f), max(x[1] for x in f),
                                     sum(x[0] > 12 for x in f), 0)
    assert got[("n", None)] == (1, 60, None, None, 0, 0)
    assert got[("t", "9 A 9999")] == (12_500, 125_000, 5, None, 0, 0)
    assert got[("t", None)][:2] == (12_500, 150_000) and got[("t", "9999-99-99\r")][0] == 1


def test_conversion_tries_found_formats_only(spark):
    """A format that no value of the table can have is not tried on any."""
    df = spark.createDataFrame([("13/02/2024", "soon"), ("01/03/2024", None)], ["t", "none"])
    assert D.conversion_formats(df, df.columns, later=False) == {"t": ["dd/MM/yyyy"], "none": []}
    out = [tuple(r) for r in R.to_datetime(df, df.columns).collect()]
    assert out == [(dt.datetime(2024, 2, 13), None), (dt.datetime(2024, 3, 1), None)]
