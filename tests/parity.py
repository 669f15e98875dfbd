"""Compare a query with its SQL on the same files."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    return float(v) if isinstance(v, int) else str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted([tuple(canon(r[i]) for i in order) for r in rows], key=repr)


def differ(df, con, sql):
    """None if equal, else a short account."""
    res = con.execute(sql)
    a = table(df.columns, [tuple(r) for r in df.collect()])
    b = table([c[0] for c in res.description], res.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(bad)} of {len(a[1])} differ: {bad[:2]}" if bad else None
