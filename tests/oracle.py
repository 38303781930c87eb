"""Compare a query's rows with those of its SQL in DuckDB."""

import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x


def rows(found, names):
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, folder, query, sql):
    df = query(spark, folder)
    want = con.sql(sql)
    names = list(want.columns)
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), names)
