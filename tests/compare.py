"""Rows of a Spark query and of its DuckDB equivalent, made comparable."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path) or glob.glob(path):
            con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


def both(spark, sf_dir, f, sql):
    df = f(spark, sf_dir)
    con = connection(sf_dir)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    want = [dict(zip(names, map(plain, r), strict=True)) for r in out.fetchall()]
    have = [{k: plain(v) for k, v in r.asDict().items()} for r in df.collect()]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: str(sorted(r.items()))
    return sorted(map(key, have)), sorted(map(key, want))
