"""Spark rows against DuckDB rows of the same tables."""

import glob
import os

import duckdb


def tidy(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(tidy(x) for x in v)
    if isinstance(v, dict):
        return tuple(tidy(x) for x in v.values())
    return v


def compare(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(tidy(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
