"""Rows of a DataFrame and of DuckDB SQL in one order and form."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def duck(data, sql):
    con = duckdb.connect()
    for t in TABLES:
        f = f"{data}/{t}.parquet"
        if glob.glob(f):
            con.sql(f"create view {t} as select * from '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    rel = con.sql(sql)
    columns = sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    return columns, sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
