"""Rows of a query against DuckDB's."""

import math
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    return c


def rows(df):
    return Counter(tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


def expected(c, text):
    r = c.sql(text)
    at = [r.columns.index(x) for x in sorted(r.columns)]
    return Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())
