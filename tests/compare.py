"""Run a query and its oracle, and compare them as multisets."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v: object) -> str:
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(int(v)) if type(v).__name__.startswith(("int", "uint")) else str(v)

    out = df[sorted(df.columns)].copy()
    return sorted(tuple(plain(v) for v in r) for r in out.itertuples(index=False))


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b, (sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3])
