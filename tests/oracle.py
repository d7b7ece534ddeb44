"""Runs a query and its SQL side by side."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb


def tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"create view {name} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        return round(v, 9) if isinstance(v, float) else f"{v.normalize():f}" if isinstance(v, Decimal) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> int:
    out = con.sql(sql)
    assert sorted(df.columns) == sorted(out.columns)
    ours, theirs = norm(df.collect(), df.columns), norm(out.fetchall(), out.columns)
    assert ours == theirs, (len(ours), len(theirs), [x for x in zip(ours, theirs) if x[0] != x[1]][:2])
    return len(ours)
