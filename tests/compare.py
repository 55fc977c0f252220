"""Side-by-side comparison of a query with its DuckDB statement, as rows sorted by their text."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows_of(spark_df):
    cols = sorted(spark_df.columns)
    return cols, sorted(tuple(plain(r[c]) for c in cols) for r in spark_df.collect())


def oracle_rows(con, sql: str):
    rel = con.sql(sql)
    names = list(rel.columns)
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
