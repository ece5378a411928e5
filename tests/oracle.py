"""Compares a registered query with its SQL in DuckDB on one of the driver's folders."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def assert_same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(repr([plain(row[c]) for c in names]) for row in df.collect())
    found = con.execute(sql)
    columns = [x[0] for x in found.description]
    assert sorted(columns) == names
    want = sorted(repr([plain(row[columns.index(c)]) for c in names]) for row in found.fetchall())
    assert len(got) == len(want)
    assert got == want
