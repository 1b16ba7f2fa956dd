"""Compares a query with its oracle as sets of rows, values rounded to what both engines print alike."""

import datetime
import decimal
import math
import os

import duckdb

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir=DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (int, decimal.Decimal)):
        return f"{float(v):.9g}" if isinstance(v, decimal.Decimal) else (str(v) if abs(v) > 10**8 else f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return [columns[i].lower() for i in order], sorted(tuple(plain(v[i]) for i in order) for v in values)


def compare(df, connection, sql):
    """None, or what differs."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = connection.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        odd = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
        return f"{len(got[1])} and {len(want[1])} rows, {odd}"
    return None
