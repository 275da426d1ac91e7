"""Rows of a query against rows of DuckDB, whatever their order."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int | float):
        return "None" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    return str(v)


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def duck(folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def assert_same(df, connection, sql):
    out = connection.execute(sql)
    columns = [d[0] for d in out.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, out.fetchall())
