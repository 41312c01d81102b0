"""Runs a query and its SQL, and compares their rows without regard to order."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[c]) for c in names]) for r in df.collect())


def rows_of_sql(sql, data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(c) for c in names]
    return names, sorted(repr([plain(r[k]) for k in at]) for r in found.fetchall())
