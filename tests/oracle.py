"""Run a query and its SQL over the same tables, and compare rows."""

import glob
import os

import duckdb

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
