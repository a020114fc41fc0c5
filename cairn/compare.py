"""Compare queries with their SQL: row count, columns, values without regard to order. Used by tests and by hand."""

from __future__ import annotations

import math
from pathlib import Path

import pandas as pd


def duck(sf_dir: str):
    """A DuckDB connection with a view for each table of a data folder."""
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        return _plain(v.item())
    if type(v).__name__ == "Decimal":
        return _plain(float(v)) if v != v.to_integral_value() else int(v)
    return v


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in r) for r in frame[cols].itertuples(index=False)), key=repr)


def differences(spark, sf_dir: str, query, sql: str, con=None) -> str:
    """'' if query and SQL agree, else what differs."""
    got = query(spark, sf_dir)
    mine = rows(pd.DataFrame([r.asDict(recursive=False) for r in got.collect()], columns=got.columns))
    con = con or duck(sf_dir)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    theirs = rows(pd.DataFrame(res.fetchall(), columns=cols))
    if sorted(got.columns) != sorted(cols):
        return f"columns {sorted(got.columns)} and {sorted(cols)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} and {len(theirs)}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"{a} and {b}"
    return ""
