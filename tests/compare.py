"""Rows of Spark and DuckDB in one comparable form."""

import decimal
import math

SMALL = "/root/testdata/sf0.001"


def form(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    if isinstance(v, float):
        if abs(v - round(v)) > 1e-9:
            return f"{v:.9g}"
        return f"{v:.6g}" if abs(v) < 10**6 else str(round(v))
    if isinstance(v, list):
        return "[" + ",".join(map(form, v)) + "]"
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(form(r[n]) for n in names) for r in df.collect())


def rows_of_duckdb(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    return names, sorted(tuple(form(r[k]) for k in at) for r in rel.fetchall())


def database(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con
