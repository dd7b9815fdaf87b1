"""Spark rows against DuckDB rows, in any order."""

import os

import duckdb


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{file}')")
    return con


def check(df, con, sql):
    got = rows_of(df.columns, df.collect())
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows_of(want.columns, want.fetchall())
