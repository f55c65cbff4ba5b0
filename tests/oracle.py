"""Runs a query and its SQL on the same tables and compares their rows."""

import math
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def database(sf_dir=SF):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def rows(df):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "-"
        kind = getattr(getattr(v, "dtype", None), "kind", None)
        if isinstance(v, bool) or kind == "b":
            return str(bool(v))
        return repr(float(v)) if isinstance(v, (int, float)) or kind in ("i", "u", "f") else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def same(query, sql, spark, sf_dir=SF):
    mine, other = query(spark, sf_dir).toPandas(), database(sf_dir).sql(sql).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)
