"""Every query with SQL is held against DuckDB on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, datetime.datetime):
        return str(x)[:10]
    if isinstance(x, datetime.date | pd.Timestamp):
        return str(x)[:10]
    if hasattr(x, "item"):
        return plain(x.item())
    if isinstance(x, float):
        return int(x) if x == int(x) else round(x, 6)
    return x


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(plain, r)) for r in frame[cols].itertuples(index=False)), key=str)


@pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())
