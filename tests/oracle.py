"""Comparison of a query with its SQL in DuckDB, without regard to the order of rows."""

import glob
import os

import duckdb
import pandas as pd


def rows(frame: pd.DataFrame) -> list[tuple]:
    def one(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, bool):
            return str(int(x))
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(one(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def assert_same(df, sql: str, sf_dir: str) -> None:
    found = df.toPandas()
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    wanted = con.execute(sql).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
