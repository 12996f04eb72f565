"""Runs a registered query and its SQL on the same files and tells how their results differ."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return ("nan" if math.isnan(v) else f"{v:.9g}") if v else "0"
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, decimal.Decimal)):
        return str(v) if isinstance(v, int) else f"{float(v):.9g}"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in records)


FAMILY = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "huge",
          "double": "float", "float": "float", "varchar": "text", "string": "text", "timestamp_ntz": "timestamp"}


def difference(df, con, sql: str) -> str | None:
    """None when the same, else what differs."""
    found = con.sql(sql)
    theirs = rows(found.columns, found.fetchall())
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} / {sorted(found.columns)}"
    kinds = {n: FAMILY.get(t, t) for n, t in df.dtypes}
    others = {n: FAMILY.get(str(t).lower(), str(t).lower()) for n, t in zip(found.columns, found.types)}
    if kinds != others:
        return f"types { {n: (kinds[n], others[n]) for n in kinds if kinds[n] != others[n]} }"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows / {len(theirs)}"
    apart = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(apart)} of {len(ours)} rows differ, e.g. {apart[0]}" if apart else None
