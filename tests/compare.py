"""A Spark result held against the same result as SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{t}')")
    return con


def plain(v):
    if v is None or v is pd.NaT:
        return "NULL"
    if isinstance(v, list | tuple | np.ndarray):
        return str([plain(x) for x in v])
    if isinstance(v, float | np.floating):
        return "NULL" if v != v else repr(float(f"{v:.10g}"))
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | np.integer):
        return str(int(v))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))
