"""Every catalog query with an oracle matches DuckDB at sf0.001."""

import hashlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from panelcast.sources.tables import TABLES

SQL = E.oracle_sql()


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)):
        return None
    if isinstance(v, pd.Timestamp) or hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        # Whole numbers beside nulls are doubles in one frame and integers in the other.
        return int(v) if v.is_integer() else round(v, 6) + 0.0
    return v


def _digest(df):
    cols = sorted(df.columns)
    rows = sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)),
                  key=repr)
    return hashlib.sha1(repr(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf_small, con, name):
    got = E.queries()[name](spark, sf_small).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _digest(got) == _digest(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert "lag_1" in df.columns and df.count() > 0
