"""Runs a query and its SQL over the same tables and compares the rows."""

import collections
import datetime
import decimal
import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        path = os.path.join(folder, f)
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, collections.Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, collections.Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def assert_same(query, sql, spark, folder, con):
    got_cols, got = rows_of(query(spark, folder))
    cols, want = sql_rows(con, sql)
    assert got_cols == cols
    assert got == want, f"only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"
