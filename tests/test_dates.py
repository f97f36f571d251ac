"""Layouts of text dates (C-01)."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelcast.functions import dates
from panelcast.operators.clean import clean_sales

D = datetime
LAYOUTS = [
    (["05-Jan-2024", "13-Feb-2024"], [D(2024, 1, 5), D(2024, 2, 13)]),
    (["Jan-24", "Feb-99"], [D(2024, 1, 1), D(1999, 2, 1)]),
    (["1/5/24", "12/31/68"], [D(2024, 1, 5), D(2068, 12, 31)]),
    (["January 5, 2024", "May 15, 2024"], [D(2024, 1, 5), D(2024, 5, 15)]),
    (["5.1.2024", "12.11.2024"], [D(2024, 5, 1), D(2024, 12, 11)]),
    (["5.1.2024", "31.12.2024"], [D(2024, 1, 5), D(2024, 12, 31)]),
    (["2024.01.05", "2024.12.31"], [D(2024, 1, 5), D(2024, 12, 31)]),
    (["1/5/2024 10:30 PM", "1/5/2024 12:05 AM"], [D(2024, 1, 5, 22, 30), D(2024, 1, 5, 0, 5)]),
    (["2024-01-05 10:30 PM", "2024-01-06 12:00 pm"], [D(2024, 1, 5, 22, 30), D(2024, 1, 6, 12)]),
    (["2024-01-05T10:00:00+0000", "2024-01-05T10:00:00+0230"], [D(2024, 1, 5, 10), D(2024, 1, 5, 7, 30)]),
    (["Fri, 05 Jan 2024 10:00:00 +0000", "Sat, 06 Jan 2024 10:00:00 GMT"], [D(2024, 1, 5, 10), D(2024, 1, 6, 10)]),
    (["2024-1-5", "2024-01-06 7:08:09.25"], [D(2024, 1, 5), D(2024, 1, 6, 7, 8, 9, 250000)]),
    (["2024-01-05T10:00:00.123Z", "2024-01-05T10:00"], [D(2024, 1, 5, 10, 0, 0, 123000), D(2024, 1, 5, 10)]),
    (["2024/1/5", "2024/01/06 09:30"], [D(2024, 1, 5), D(2024, 1, 6, 9, 30)]),
    (["1/5/2024", "1/25/2024"], [D(2024, 1, 5), D(2024, 1, 25)]),
    (["1/5/2024", "25/1/2024"], [D(2024, 5, 1), D(2024, 1, 25)]),
    (["1-5-2024", "25-1-2024"], [D(2024, 5, 1), D(2024, 1, 25)]),
    (["20240105", "20241231"], [D(2024, 1, 5), D(2024, 12, 31)]),
    (["2024-01", "2024-12"], [D(2024, 1, 1), D(2024, 12, 1)]),
    (["Jan 2024", "December 2024"], [D(2024, 1, 1), D(2024, 12, 1)]),
    (["5 Jan 2024", "6 Sept 2024"], [D(2024, 1, 5), D(2024, 9, 6)]),
    (["Jan 5, 2024", "Feb. 29, 2024"], [D(2024, 1, 5), D(2024, 2, 29)]),
    (["01/2024", "12/2024"], [D(2024, 1, 1), D(2024, 12, 1)]),
    (["2024", "1999"], [D(2024, 1, 1), D(1999, 1, 1)]),
    (["  2024-01-05 ", "\t2024-01-06"], [D(2024, 1, 5), D(2024, 1, 6)]),
    (["99/01/05", "50/12/31"], [D(1999, 1, 5), D(2050, 12, 31)]),
    (["2024-Jan-05", "2024-Feb-01"], [D(2024, 1, 5), D(2024, 2, 1)]),
]
NONE = [["2024-01-05", "1/5/2024"], ["1/5/2024", "13/25/2024"], ["2024-02-30"], ["2024-01-05", "soon"], ["12.5"], ["7"], [""],
        ["2024-01-05 25:00"], ["2024-01-05 13:00 PM"], ["Foo 5, 2024"], ["2024-01-05T10:00:61"], ["24-Jan"], ["2024-01-05 10:30 +9900"]]


def read(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df = dates.with_readings(df, "t", "p")
    df = df.withColumn("at", dates.layout(df, "p", "t"))
    return [(r[0], r[1]) for r in df.orderBy("i").select(
        "at", dates.parsed(F.col("p"), F.col("at"))).collect()]


@pytest.mark.parametrize("texts,want", LAYOUTS, ids=[t[0][0] + "|" + t[0][1] for t in LAYOUTS])
def test_layouts(spark, texts, want):
    got = read(spark, texts + [None])
    assert [g[1] for g in got] == want + [None]


@pytest.mark.parametrize("texts", NONE, ids=[t[-1] for t in NONE])
def test_no_layout(spark, texts):
    assert all(at is None for at, _ in read(spark, texts))


def test_empty_columns_have_the_first_layout(spark):
    assert read(spark, [None, None]) == [(0, None)] * 2


def test_one_bad_text_discards_the_column(spark):
    rows = [(i, f"{i + 1:02d}-Jan-2024", float(i)) for i in range(5)]
    got, log = clean_sales(spark.createDataFrame(rows, "seq long, order_date string, sales double"), seq="seq")
    assert [r["date"] for r in got.orderBy("seq").collect()] == [D(2024, 1, i + 1) for i in range(5)]
    rows[3] = (3, "04/Jan/2024", 3.0)
    got, log = clean_sales(spark.createDataFrame(rows, "seq long, order_date string, sales double"), seq="seq")
    assert [r["date"] for r in got.orderBy("seq").collect()] == [D(2022, i + 1, 1) for i in range(5)]
    assert any("Could not parse" in r["msg"] for r in log.collect())


def test_given_formats_win(spark):
    df = spark.createDataFrame([(0, "5|1|2024", 1.0)], "seq long, order_date string, sales double")
    got, _ = clean_sales(df, seq="seq", formats=["yyyy", "d|M|yyyy"])
    assert got.first()["date"] == D(2024, 1, 5)
