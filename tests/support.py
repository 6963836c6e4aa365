"""Comparison of a query with its SQL in DuckDB."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9e}")
    if isinstance(x, decimal.Decimal):
        return plain(float(x)) if x % 1 else int(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)


def sql_rows(sql: str, sf_dir) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[k]) for k in order) for r in done.fetchall()), key=repr)
