"""Comparing a query with its SQL on the same parquet files."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = DATA):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    v = float(v)
    return "nan" if math.isnan(v) else float(f"{v:.8g}")


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(c, sql):
    r = c.sql(sql)
    order = sorted(range(len(r.columns)), key=r.columns.__getitem__)
    return [r.columns[i] for i in order], sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)
