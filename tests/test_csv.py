"""CSV reading with pandas missing tokens and type inference."""

import os
import tempfile

import pytest

from tabsight.sources import read_csv


def test_na_tokens_and_types(spark):
    d = tempfile.mkdtemp(prefix="tabsight-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write("i,x,s,b,dash\n")
        f.write("1,1.5,a,True,-\n")
        f.write("2,NA,n/a,False,-\n")
        f.write("3,,null,true,-\n")
        f.write("4,nan,None,False,x\n")
    df = read_csv(spark, path)
    types = dict(df.dtypes)
    assert types == {"i": "bigint", "x": "double", "s": "string", "b": "boolean", "dash": "string"}
    rows = df.orderBy("i").collect()
    assert [r["x"] for r in rows] == [1.5, None, None, None]
    assert [r["s"] for r in rows] == ["a", None, None, None]
    assert [r["dash"] for r in rows] == ["-", "-", "-", "x"]


def test_quoted_fields(spark):
    d = tempfile.mkdtemp(prefix="tabsight-csv-")
    path = os.path.join(d, "q.csv")
    with open(path, "w") as f:
        f.write('id,name\n')
        f.write('1,"Smith, John"\n')
        f.write('2,"say ""hi"""\n')
    rows = read_csv(spark, path).orderBy("id").collect()
    assert [r["name"] for r in rows] == ["Smith, John", 'say "hi"']


def test_multiline_fields(spark):
    d = tempfile.mkdtemp(prefix="tabsight-csv-")
    path = os.path.join(d, "m.csv")
    with open(path, "w") as f:
        f.write('id,note\n1,"two\nlines"\n2,plain\n')
    rows = read_csv(spark, path, multiline=True).orderBy("id").collect()
    assert [r["note"] for r in rows] == ["two\nlines", "plain"]


def test_write_read_round_trip_with_quotes(spark):
    import pandas as pd
    from tabsight.sources import write_csv
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, None)], "id bigint, s string")
    d = tempfile.mkdtemp(prefix="tabsight-csv-")
    path = os.path.join(d, "out")
    write_csv(df, path)
    back = read_csv(spark, path).orderBy("id").collect()
    assert [r["s"] for r in back] == ['a "quoted", text', None]
    parts = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".csv")]
    pdf = pd.concat(pd.read_csv(p) for p in parts).sort_values("id")
    assert pdf["s"].iloc[0] == 'a "quoted", text'


def written(text):
    path = os.path.join(tempfile.mkdtemp(prefix="tabsight-csv-"), "f.csv")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_line_breaks_in_quotes_without_an_option(spark):
    rows = read_csv(spark, written('id,note,n\n1,"two\nlines, ""so""",5\n2,plain,6\n')).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'two\nlines, "so"', 5), (2, "plain", 6)]
    rows = read_csv(spark, written('id,size\n1,5" disk\n2,7\n')).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, '5" disk'), (2, "7")]


@pytest.mark.parametrize("row", ["6,7,,8", "6,7,8,", "6,,,", "6,7,,,9", '"6,1",7,"",8', ',,,""'])
def test_rows_with_too_many_fields_are_an_error(spark, row):
    with pytest.raises(Exception, match="more fields than the header"):
        read_csv(spark, written(f"a,b,c\n1,2,3\n{row}\n")).collect()


def test_short_rows_and_quoted_separators_are_not_too_long(spark):
    rows = read_csv(spark, written('a,b,c\n1\n2,"x,y,z,w"\n3,"p,q",r\n4,,\n')).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, None, None), (2, "x,y,z,w", None), (3, "p,q", "r"), (4, None, None)]
