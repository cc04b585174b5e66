"""Comparison of a query's rows with DuckDB's."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return float(v) if isinstance(v, float) else v


def rows_of_sql(sql: str, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    out = con.sql(sql)
    order = sorted(range(len(out.columns)), key=lambda i: out.columns[i])
    return [out.columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in out.fetchall()), key=repr)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(value(r[n]) for n in names) for r in df.collect()), key=repr)


def check(spark, query, sql, data=DATA):
    names, got = rows_of(query(spark, str(data)))
    expected_names, expected = rows_of_sql(sql, data)
    assert names == expected_names
    assert len(got) == len(expected)
    assert got == expected
