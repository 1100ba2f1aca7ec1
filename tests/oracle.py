"""A query's rows beside those of its SQL in DuckDB, over the same tables."""

import glob
import os

import duckdb
import pandas as pd

SF_DIR = "/root/testdata/sf0.001"


def connect(sf_dir=SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame: pd.DataFrame):
    """Rows in any order, columns by name; nulls of any kind are one, floats have six digits."""

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        v = v.item() if hasattr(v, "item") else v
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


def assert_equal(spark, query, sql, sf_dir=SF_DIR):
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
