"""Number texts against Python's exact formatting."""

import random

import pytest
from pyspark.sql import functions as F

from panelcast.functions.numbers import filled, fixed, money

TIES = [56.25, 0.125, 2.675, 1.005, 0.0005, 0.00049999999, -0.04, -0.0, 0.0, 0.5, 1.5, 2.5, -2.5, 0.05, 0.15, 0.25, 0.35, 0.45,
        999999.95, 99999.995, 0.9999999, 1e15 + 0.5, 2.0 ** 52 + 0.5, 2.0 ** 53 - 1, 2.0 ** 60, 2.0 ** 63, 1e22, 1e23, 3.5e37,
        5e-324, 1e16 / 3, 12345678.125, 842.0000005]


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(1)
    v = TIES + [-t for t in TIES]
    v += [rng.randint(-10**9, 10**9) / 8 for _ in range(3000)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-5, 30) for _ in range(3000)]
    v += [rng.randint(-10**7, 10**7) / 1000 for _ in range(3000)]
    v += [(rng.randint(-10**8, 10**8) + 0.5) / 10 ** rng.randint(0, 3) for _ in range(3000)]
    return spark.createDataFrame([(x,) for x in v], "x double").cache()


@pytest.mark.parametrize("places", [0, 1, 2, 3, 6, 15])
def test_fixed_is_exact(values, places):
    got = values.select("x", fixed(F.col("x"), places), fixed(F.col("x"), places, plus=True),
                        fixed(F.col("x"), places, grouped=True)).collect()
    bad = [r for r in got if (r[1], r[2], r[3]) != (f"{r[0]:.{places}f}", f"{r[0]:+.{places}f}", f"{r[0]:,.{places}f}")]
    assert not bad, bad[:5]


def test_fixed_of_nothing_and_beyond(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r[0] for r in df.select(fixed(F.col("x"), 1)).collect()] == [None, "nan", "inf", "-inf"]
    with pytest.raises(ValueError):
        fixed(F.col("x"), 16)


def test_filled_and_money(spark):
    df = spark.createDataFrame([(7, 56.25, "ab", 1234567.5, -0.25)], "d int, x double, s string, m double, y double")
    c = F.col
    got = df.select(filled("%s: %+d%% gives %+.1f%%, %.2f and %,.1f", c("s"), c("d"), c("x"), c("y"), c("m")), money(c("m")), money(c("x"), 1)).first()
    assert got[0] == "ab: +7% gives +56.2%, -0.25 and 1,234,567.5"
    assert tuple(got[1:]) == ("$1,234,568", "$56.2")
    with pytest.raises(ValueError):
        filled("%s", c("s"), c("d"))


def test_plain_is_the_shortest_text(values):
    from panelcast.functions.numbers import plain
    got = values.where("abs(x) >= 0.0001 and abs(x) < 1e15").select("x", plain(F.col("x"))).collect()
    assert all(float(t) == x and "E" not in t for x, t in got)
    assert sum(t != repr(x) for x, t in got) < len(got) / 100  # older runtimes give a digit more now and then
