"""Runs a query and its SQL on the same tables and compares all rows."""

import decimal
import glob
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def both(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    return ours, theirs
