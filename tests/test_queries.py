"""Every registered query of the engine against its SQL on DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from graphloom.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(x: object) -> str:
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return "null"
        x = x.item() if hasattr(x, "item") else x
        if isinstance(x, float):
            return repr(int(x)) if x == int(x) else repr(round(x, 6))
        return repr(x)

    cols = sorted(df.columns)
    return sorted(tuple(value(x) for x in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, data, duck, name):
    mine, theirs = QUERIES[name](spark, data).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    QUERIES[name](spark, data).collect()


def test_entry(spark):
    import __spark_entry__

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no data")
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
