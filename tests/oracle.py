"""Comparing a query with its SQL on the same tables."""

import math
from pathlib import Path

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, bool) or x is None:
        return x
    return int(x) if isinstance(x, int) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(value(r[i]) for i in order) for r in data], key=repr)


def compare(spark, con, sf, query, sql):
    df = query(spark, sf)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    theirs = rows(names, out.fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs), [r for r in mine if r not in theirs][:3], [r for r in theirs if r not in mine][:3])
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(mine)
