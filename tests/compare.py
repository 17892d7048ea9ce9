"""A query and its SQL side by side: the same columns, rows and values in any order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pyarrow.dataset as ds

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.register(t, ds.dataset(f"{sf_dir}/{t}.parquet").to_table())
    return con


def _plain(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    value = value.item() if hasattr(value, "item") else value
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value


def normal(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns in order of name; whole floats (integers that met a null) count as integers."""
    columns = [[_plain(v) for v in frame[c].astype(object)] for c in sorted(frame.columns)]
    rows = [tuple(int(v) if isinstance(v, float) and v == int(v) else v for v in row) for row in zip(*columns)]
    return sorted(rows, key=repr)


def difference(got: pd.DataFrame, wanted: pd.DataFrame) -> str:
    """Empty if equal, else what differs."""
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} against {sorted(wanted.columns)}"
    a, b = normal(got), normal(wanted)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; first of ours {a[:2]}, of theirs {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}" if bad else ""
