"""Comparison of a registered query with its DuckDB text."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if isinstance(v, (int, bool)) else round(float(v), 5) if type(v).__name__ == "Decimal" else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(v is not None, str(type(v)), v if v is not None else 0) for v in r])


def same(df, con, sql):
    want = con.sql(sql)
    columns, got = list(want.columns), df.collect()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, want.fetchall())
