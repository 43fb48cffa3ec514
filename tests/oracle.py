"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import os

DATA = os.environ.get("VDJLAKE_TESTDATA", "/root/testdata/sf0.001")


def connection():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def text(v) -> str:
    import numpy as np
    import pandas as pd

    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(text, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return f"{v:.8g}"
    return str(int(v)) if isinstance(v, np.integer) else str(v)


def rows(pdf, columns) -> list:
    return sorted(tuple(text(v) for v in r) for r in pdf[columns].itertuples(index=False))


def same(spark, query, sql) -> None:
    got, want = query(spark, DATA).toPandas(), connection().execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
