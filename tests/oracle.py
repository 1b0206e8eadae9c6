"""Compares a query's rows with those of its SQL on the same tables."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def connect(data: Path = DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in data.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def same(df, c, sql):
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    expect = sorted(tuple(plain(r[names.index(n)]) for n in order) for r in got.fetchall())
    rows = sorted(tuple(plain(r[n]) for n in order) for r in df.collect())
    assert rows == expect
