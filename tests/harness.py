"""Runs a query and its SQL side by side and compares rows without order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if v is None:
        return None
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    return tuple(map(value, v)) if isinstance(v, list | tuple) else v


def rows_of_query(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(value(r[c]) for c in cols)) for r in df.collect())


def rows_of_sql(con, sql: str):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    cols = sorted(names)
    return cols, sorted(repr(tuple(value(r[names.index(c)]) for c in cols)) for r in rel.fetchall())
