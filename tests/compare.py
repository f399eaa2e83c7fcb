"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]) or df[c].map(lambda v: isinstance(v, float)).any():
            df[c] = df[c].map(lambda v: None if pd.isna(v) else f"{float(v):.9g}")
        else:
            df[c] = df[c].map(lambda v: None if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True) if len(df.columns) else df


def difference(got: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} against {sorted(expected.columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    a, b = rows(got.copy()), rows(expected.copy())
    for c in a.columns:
        bad = [i for i, (x, y) in enumerate(zip(a[c], b[c])) if x != y]
        if bad:
            return f"{len(bad)} values of {c}, first {a.loc[bad[0]].to_dict()} against {b.loc[bad[0]].to_dict()}"[:1500]
    return None
