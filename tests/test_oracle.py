"""Every query with a SQL twin gives the same rows in Spark and in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark import queries as engine

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not SF.exists():
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) else str(x)
    return list(df.columns), sorted(str([plain(x) for x in r]) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    assert rows_of(engine.QUERIES[name](spark, str(SF)).toPandas()) == rows_of(duck.execute(engine.ORACLE_SQL[name]).fetchdf())
