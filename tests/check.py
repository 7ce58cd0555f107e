"""Comparing a query with its SQL on the same tables."""

import math
import os

import duckdb


def views(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


def same_rows(df, sql, folder):
    rows, cols = df.collect(), sorted(df.columns)
    found = views(folder).execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    ours = sorted(repr([plain(r[c]) for c in cols]) for r in rows)
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    assert ours == theirs
