"""Compare a query's rows with its SQL in DuckDB."""

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return plain(v.item()) if hasattr(v, "item") else v


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(names)
    return order, sorted((tuple(plain(x[names.index(c)]) for c in order) for x in r.fetchall()), key=repr)


def assert_same(df, sf_dir, sql):
    order, want = sql_rows(sf_dir, sql)
    assert sorted(df.columns) == order
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr) == want
