"""Spark results against DuckDB's for the same query name and tables."""

import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: repr(v) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[k]) for k in order) for r in rows)


def duck(sql, data=DATA):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    out = con.execute(sql)
    columns = [c[0] for c in out.description]
    return sorted(columns), rows_of(columns, out.fetchall())


def check(spark, fn, sql, data=DATA):
    df = fn(spark, data)
    columns, want = duck(sql, data)
    assert sorted(df.columns) == columns
    assert rows_of(df.columns, df.collect()) == want
