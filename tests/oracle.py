"""Comparing a query with its SQL in DuckDB."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


def compare(df, sql: str, folder: str) -> tuple[list, list]:
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    cursor = connect(folder).execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    return got, sorted(tuple(plain(r[k]) for k in order) for r in cursor.fetchall())
