"""Every query with SQL, against DuckDB on the smallest test tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace.plans import registry

DIR = os.environ.get("MILLRACE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(value):
    if hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return repr(value.tolist())
    if not isinstance(value, list) and pd.isna(value):
        return "None"
    if isinstance(value, (int, float, np.number)) and not isinstance(value, (bool, np.bool_)):
        return repr(round(float(value), 6) + 0.0)
    return repr(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame = frame.assign(**{c: frame[c].dt.tz_localize(None).astype("datetime64[us]").astype(str)})
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert rows_of(registry.queries()[name](spark, DIR).toPandas()) == rows_of(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - {"answer_pipeline"}))
def test_has_rows(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0
