"""Compare a query with its SQL in DuckDB over the same parquet files."""

import glob
import os

import duckdb


def shown(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def assert_equal(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want, got = con.sql(sql), query(spark, sf_dir)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(tuple(shown(r[n]) for n in names) for r in got.collect()) == sorted(tuple(shown(r[k]) for k in at) for r in want.fetchall())
