"""Comparing a Spark query with its SQL in DuckDB, without regard to the order of rows and columns."""

import glob
import os

import duckdb
import pandas as pd

FOLDER = "/root/testdata/sf0.001"


def connection(folder=FOLDER):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def value(v):
    if v is None or v is pd.NA or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(value(v) for v in r) for r in df.astype(object).values.tolist())
