"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"create view {path.stem} as select * from '{source}'")
    return con


def plain(x):
    """A value as both engines can write it."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    return x


def rows_of(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in df.select(*[f"`{c}`" for c in names]).collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in found.fetchall())


def difference(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    names, ours = rows_of(df)
    others, theirs = sql_rows(con, sql)
    if names != others:
        return f"columns {names} and {others}"
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only SQL {list((theirs - ours).items())[:3]}"
    return ""
