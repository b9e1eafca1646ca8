"""Queries on tables whose rows are repeated with shifted keys: many ticks of one instant, the same rows as their SQL."""

import duckdb
import pytest

from tests.test_oracle import SF, rows_of
from tidemark import queries as engine

COPIES = {"events": ("event_id", 3), "lineitem": ("l_orderkey", 3)}


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    if not SF.exists():
        pytest.skip("no driver tables here")
    root, con = tmp_path_factory.mktemp("repeated"), duckdb.connect()
    for table, (key, n) in COPIES.items():
        con.execute(f"copy (select * replace ({key} + i * (select max({key}) + 1 from '{SF}/{table}.parquet') as {key}) from '{SF}/{table}.parquet', range({n}) r(i)) to '{root}/{table}.parquet'")
        con.execute(f"create view {table} as select * from '{root}/{table}.parquet'")
    return root, con


@pytest.mark.parametrize("name", ["OP05_month_files", "OP124_column_order_by_day", "OP126_stamp_clock", "OP18_feature_merge", "SPEC_fills"])
def test_same_rows_of_repeated_tables(spark, repeated, name):
    root, con = repeated
    assert rows_of(engine.QUERIES[name](spark, str(root)).toPandas()) == rows_of(con.execute(engine.ORACLE_SQL[name]).fetchdf())
