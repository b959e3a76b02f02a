"""Registered queries against their SQL on the smallest generated tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemart.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    """Rows as texts in order: whole numbers exactly, others to nine digits."""

    def text(v: object) -> str:
        if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, np.integer)) or (isinstance(v, (float, np.floating)) and v == int(v) and abs(v) < 2**53):
            return str(int(v))
        return f"{v:.9g}" if isinstance(v, (float, np.floating)) else str(v)

    columns = sorted(df.columns)
    return sorted(tuple(map(text, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got, expected = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
